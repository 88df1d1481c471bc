"""Evaluation: IR metrics of neighbour runs against lexicon classes,
classification reports, correlations.

Per-query metrics use windows partitioned by query, whose groups are bounded
by the run depth k; corpus-level ranks use the global ordering helper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.operators.ordering import average_rank
from lexivec.session import sized_broadcast

CUTOFFS = (1, 5, 10)
# Precision cutoffs of a full evaluation.
TREC_CUTOFFS = (1, 2, 5, 10, 25, 50, 100, 200, 500, 1000)


def qrels(lexicon: DataFrame, include_query: bool = True) -> DataFrame:
    """E1 qrel in implicit form: every word of the query's class is relevant
    (query included), so the judgments are ``(qid, cls, num_rel)`` and a run
    row is relevant iff its word has the query's class.  The pairwise qrel
    file (|class|^2 lines) is not materialised; :func:`ir_metrics` joins on
    the class instead.  ``include_query=False`` (E8) leaves the query out of
    its own relevant set; queries with nothing relevant are then dropped, as
    they have no qrel line."""
    sizes = lexicon.groupBy("cls").agg(F.count(F.lit(1)).alias("num_rel"))
    if not include_query:
        sizes = sizes.select("cls", (F.col("num_rel") - 1).alias("num_rel")).where(F.col("num_rel") > 0)
    return (lexicon.join(sized_broadcast(sizes), "cls")
            .select(F.col("term").alias("qid"), F.lit(0).alias("iter"), "cls", F.col("num_rel").cast("long").alias("num_rel")))


def signature_lexicon(flags: DataFrame, word_col: str = "word", flags_col: str = "flags") -> DataFrame:
    """Words with identical affect signatures are mutually relevant.  The
    signature is the ordered 0/1 flags of a word (S25) joined into one string
    and used as the class of ``(term, cls)``; all-zero signatures are skipped.
    Use with ``qrels``/``ir_metrics`` and ``include_query=False``: the
    relevance stays implicit (one join on the signature), so a signature
    shared by a third of the vocabulary never expands into word pairs."""
    sig = F.array_join(F.transform(F.col(flags_col), lambda x: x.cast("string")), "")
    return (flags.where(F.exists(F.col(flags_col), lambda x: x != 0))
                 .select(F.col(word_col).alias("term"), sig.alias("cls")))


def ir_metrics(run: DataFrame, lexicon: DataFrame, k: int, include_query: bool = True,
               cutoffs: tuple[int, ...] = CUTOFFS, full: bool = False) -> DataFrame:
    """Per-query P@c for each of ``cutoffs``, average precision, reciprocal
    rank and nDCG@k of a run ``(query, word, rank)`` against class relevance.
    ``full`` adds the numbers of relevant and of retrieved relevant words,
    recall at the run's depth, R-precision and bpref.  The judgments name
    relevant words only, so no judged word can be ranked wrongly above one and
    bpref equals the recall.
    ``num_rel`` is the class size (the query counts, as in the qrels), or the
    class size minus one with ``include_query=False`` (E8; queries without any
    other relevant word are not evaluated)."""
    lex = lexicon.select(F.col("term"), F.col("cls"))
    sizes = lex.groupBy("cls").agg(F.count(F.lit(1)).alias("num_rel"))
    if not include_query:
        sizes = sizes.select("cls", (F.col("num_rel") - 1).alias("num_rel")).where(F.col("num_rel") > 0)
    qcls = lex.select(F.col("term").alias("query"), F.col("cls").alias("qcls")).join(
        sizes.withColumnRenamed("cls", "qcls"), "qcls")
    # The run is many times the lexicon, which goes to it where it is proven small.
    r = (run.join(sized_broadcast(lex.select(F.col("term").alias("word"), F.col("cls").alias("wcls"))), "word", "left")
            .join(sized_broadcast(qcls), "query")
            .withColumn("rel", (F.col("wcls") == F.col("qcls")).cast("int")).fillna(0, ["rel"]))
    w = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("cum_rel", F.sum("rel").over(w))
    aggs = [(F.sum(F.when(F.col("rank") <= c, F.col("rel")).otherwise(0)) / F.lit(float(c))).alias(f"p{c}") for c in cutoffs]
    aggs += [
        (F.sum(F.when(F.col("rel") == 1, F.col("cum_rel") / F.col("rank")).otherwise(0.0)) / F.first("num_rel")).alias("ap"),
        F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("rel") == 1, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.first("num_rel").alias("num_rel"), F.first("qcls").alias("cls"),
        F.sum("rel").alias("num_rel_ret"),
        F.sum(F.when(F.col("rank") <= F.col("num_rel"), F.col("rel")).otherwise(0)).alias("_at_r"),
    ]
    m = r.groupBy("query").agg(*aggs)
    # ideal DCG over min(k, num_rel) relevant documents (closed-form prefix sums)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("num_rel"), F.lit(k)).cast("int")), F.lit(0.0),
                        lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    m = m.withColumn("ndcg", F.col("dcg") / ideal)
    cols = [f"p{c}" for c in cutoffs] + ["ap", "rr", "ndcg"]
    if full:
        share = F.col("num_rel_ret") / F.col("num_rel")
        m = (m.withColumn("recall", share).withColumn("bpref", share)
              .withColumn("rprec", F.col("_at_r") / F.col("num_rel"))
              .withColumn("num_rel", F.col("num_rel").cast("double"))
              .withColumn("num_rel_ret", F.col("num_rel_ret").cast("double")))
        cols += ["num_rel", "num_rel_ret", "recall", "rprec", "bpref"]
    return m.select("query", "cls", *[F.round(c, 6).alias(c) for c in cols])


def summarize(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of every metric (MAP, MRR, mean P@k, mean nDCG), optionally per group."""
    cols = [c for c in metrics.columns if c not in ("query", "cls")]
    aggs = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in cols] + [F.count(F.lit(1)).alias("n_queries")]
    return metrics.groupBy(*(by or [])).agg(*aggs)


def classification_report(pred: DataFrame, gold_col: str = "gold", pred_col: str = "pred") -> DataFrame:
    """A8 (+A15 fixed): per class precision, recall, F1 = 2PR/(P+R), support.
    One confusion aggregate; everything else is derived from that small table."""
    conf = pred.groupBy(F.col(gold_col).alias("g"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    per = (conf.select(F.explode(F.array(
                F.struct(F.col("g").alias("cls"), F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0).alias("tp"),
                         F.lit(0).cast("long").alias("npred"), F.col("c").alias("support")),
                F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"), F.col("c").alias("npred"),
                         F.lit(0).cast("long").alias("support")))).alias("x"))
               .select("x.*").groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("npred").alias("npred"),
                                                 F.sum("support").alias("support")))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    j = per.select("cls", prec.alias("precision"), rec.alias("recall"), F.col("support").cast("long").alias("support"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.select("cls", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                    F.round(f1, 6).alias("f1"), "support")


def semeval_score(report: DataFrame) -> DataFrame:
    """(F1_positive + F1_negative) / 2 from a classification report."""
    return report.agg(F.round((F.sum(F.when(F.col("cls") == "positive", F.col("f1")).otherwise(0.0))
                               + F.sum(F.when(F.col("cls") == "negative", F.col("f1")).otherwise(0.0))) / 2.0, 6)
                      .alias("semeval_f1"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation (built-in ``corr``, partial-aggregated)."""
    return df.agg(F.round(F.corr(x, y), 6).alias("pearson"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Spearman = Pearson of average-tie ranks (global ranks)."""
    rx = average_rank(df.select(key, x), x, key, "rx").select(key, "rx")
    ry = average_rank(df.select(key, y), y, key, "ry").select(key, "ry")
    return rx.join(ry, key).agg(F.round(F.corr("rx", "ry"), 6).alias("spearman"), F.count(F.lit(1)).alias("n"))


def best_of(metrics: DataFrame, metric: str, by: list[str], choice_cols: list[str]) -> DataFrame:
    """Per group ``by``, the row with the best ``metric``.  Accuracies,
    F-measures and the retrieval metrics here are maximised; any other name
    counts as a loss and is minimised.  Ties go to the smallest choice tuple."""
    higher = ("acc", "fmeasure", "f1", "precision", "recall", "ap", "rr", "ndcg", "rprec", "bpref")
    name = metric.lower().removeprefix("mean_")
    lower_better = not (any(s in name for s in ("acc", "fmeasure")) or name in higher or name[:1] == "p" and name[1:].isdigit())
    m = F.col(metric) if lower_better else -F.col(metric)
    key = F.struct(m.alias("_m"), *[F.col(c).alias(c) for c in choice_cols])
    best = F.min(metric) if lower_better else F.max(metric)
    g = metrics.groupBy(*by).agg(F.min(key).alias("_k"), best.alias(f"best_{metric}"))
    return g.select(*by, *[F.col("_k").getField(c).alias(c) for c in choice_cols], f"best_{metric}")


def filter_run(run: DataFrame, pattern: str | None = r"^[a-z]+$", qid: str = "query", docno: str = "word") -> DataFrame:
    """Keep run documents matching ``pattern`` (non-empty), each query's
    best-ranked row per document, and number the ranks anew from 1."""
    r = run.where(F.length(docno) > 0)
    if pattern:
        r = r.where(F.col(docno).rlike(pattern))
    rest = [c for c in r.columns if c not in (qid, docno, "rank")]
    best = r.groupBy(qid, docno).agg(F.min("rank").alias("rank"), *[F.min_by(c, "rank").alias(c) for c in rest])
    again = F.row_number().over(Window.partitionBy(qid).orderBy("rank", docno))
    return best.withColumn("rank", again).select(*run.columns)
