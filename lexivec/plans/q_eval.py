"""Evaluation queries: qrels/runs, IR metrics, classification reports, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.operators import evaluate as E
from lexivec.operators import vectors as V
from lexivec.plans.catalog import query
from lexivec.plans.q_text import lex_block_uni
from lexivec.plans.q_vectors import KNN_SQL, TOPN, VEC_SQL
from lexivec.plans.sqlparts import (CLASS_SCORE_SQL, DOC_TOKENS_CTE, LEXICON_CTE, NEG_MARK_CTE, r6,
                                    score_block_cte)
from lexivec.session import written
from lexivec.sources import tables as S


def qrel(spark, sf_dir):
    return E.qrels(S.vector_lexicon(spark, sf_dir))


query("qrel", """SELECT vec_id::VARCHAR AS qid, 0 AS iter, label::VARCHAR AS cls,
  count(*) OVER (PARTITION BY label) AS num_rel FROM embeddings""")(qrel)


def run(spark, sf_dir):
    vec = S.vectors(spark, sf_dir)
    k = V.knn(vec, vec, TOPN)
    return k.select(F.col("query").alias("qid"), F.lit(0).alias("iter"), F.col("word").alias("docno"), "rank",
                    F.round("sim", 6).alias("sim"), F.lit("lexivec").alias("runid"))


query("run", f"""WITH {KNN_SQL}
SELECT query AS qid, 0 AS iter, word AS docno, rank, {r6('sim')} AS sim, 'lexivec' AS runid FROM knn""")(run)


def _metrics(spark, sf_dir):
    vec = S.vectors(spark, sf_dir)
    return E.ir_metrics(V.knn(vec, vec, TOPN), S.vector_lexicon(spark, sf_dir), TOPN)


# Per-query metrics from r(query, cls, num_rel, rank, rel); shared by E1 and E8.
IR_METRICS_SQL = f"""c AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS cum_rel FROM r),
m AS (SELECT query, cls,
  {r6('sum(CASE WHEN rank <= 1 THEN rel ELSE 0 END) / 1.0')} AS p1,
  {r6('sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) / 5.0')} AS p5,
  {r6('sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / 10.0')} AS p10,
  {r6('sum(CASE WHEN rel = 1 THEN cum_rel / rank ELSE 0 END) / any_value(num_rel)')} AS ap,
  {r6('coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0)')} AS rr,
  {r6(f'sum(CASE WHEN rel = 1 THEN 1.0 / log2(rank + 1.0) ELSE 0 END) / (SELECT sum(1.0 / log2(i + 1.0)) FROM range(1, least(any_value(num_rel), {TOPN}) + 1) t(i))')} AS ndcg
  FROM c GROUP BY query, cls)"""

IR_SQL = f"""{KNN_SQL},
sz AS (SELECT cls, count(*) AS num_rel FROM v GROUP BY cls),
r AS (SELECT k.query, q.cls, sz.num_rel, k.rank, (w.cls = q.cls)::INTEGER AS rel
      FROM knn k JOIN v q ON q.word = k.query JOIN v w ON w.word = k.word JOIN sz ON sz.cls = q.cls),
{IR_METRICS_SQL}"""


def ir_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


query("ir_metrics", f"WITH {IR_SQL} SELECT * FROM m")(ir_metrics)


def ir_summary(spark, sf_dir):
    return E.summarize(_metrics(spark, sf_dir))


_MEANS = ", ".join(f"{r6(f'avg({c})')} AS mean_{c}" for c in ["p1", "p5", "p10", "ap", "rr", "ndcg"])
query("ir_summary", f"WITH {IR_SQL} SELECT {_MEANS}, count(*) AS n_queries FROM m")(ir_summary)


def ir_by_class(spark, sf_dir):
    return E.summarize(_metrics(spark, sf_dir), by=["cls"])


query("ir_by_class", f"WITH {IR_SQL} SELECT cls, {_MEANS}, count(*) AS n_queries FROM m GROUP BY cls")(ir_by_class)


DEPTH = 100


def trec_metrics(spark, sf_dir):
    """E1 at the depth and with the metric set of a full evaluation."""
    vec = S.vectors(spark, sf_dir)
    return E.ir_metrics(V.knn(vec, vec, DEPTH), S.vector_lexicon(spark, sf_dir), DEPTH,
                        cutoffs=E.TREC_CUTOFFS, full=True)


query("trec_metrics", f"""WITH {KNN_SQL.replace(f'rank <= {TOPN}', f'rank <= {DEPTH}')},
sz AS (SELECT cls, count(*) AS num_rel FROM v GROUP BY cls),
r AS (SELECT k.query, q.cls, sz.num_rel, k.rank, (w.cls = q.cls)::INTEGER AS rel
      FROM knn k JOIN v q ON q.word = k.query JOIN v w ON w.word = k.word JOIN sz ON sz.cls = q.cls),
c AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS cum_rel FROM r)
SELECT query, cls,
  {", ".join(f"{r6(f'sum(CASE WHEN rank <= {n} THEN rel ELSE 0 END) / {n}.0')} AS p{n}" for n in E.TREC_CUTOFFS)},
  {r6('sum(CASE WHEN rel = 1 THEN cum_rel / rank ELSE 0 END) / num_rel')} AS ap,
  {r6('coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0)')} AS rr,
  {r6(f'sum(CASE WHEN rel = 1 THEN 1.0 / log2(rank + 1.0) ELSE 0 END) / (SELECT sum(1.0 / log2(i + 1.0)) FROM range(1, least(any_value(num_rel), {DEPTH}) + 1) t(i))')} AS ndcg,
  num_rel::DOUBLE AS num_rel, sum(rel)::DOUBLE AS num_rel_ret, {r6('sum(rel) / num_rel')} AS recall,
  {r6('sum(CASE WHEN rank <= num_rel THEN rel ELSE 0 END) / num_rel')} AS rprec, {r6('sum(rel) / num_rel')} AS bpref
FROM c GROUP BY query, cls, num_rel""")(trec_metrics)


def _predictions(spark, sf_dir):
    blk = lex_block_uni(spark, sf_dir)
    lab = S.load(spark, sf_dir, "labels")
    return blk.join(lab, "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("gold"),
        F.when(F.col("net") > F.lit(100.0), "positive").otherwise("negative").alias("pred"))


PRED_SQL = f"""{LEXICON_CTE}, {DOC_TOKENS_CTE}, {NEG_MARK_CTE},
{score_block_cte('mk', CLASS_SCORE_SQL, 'blk')},
pr AS (SELECT b.doc_id, CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS gold,
         CASE WHEN b.net > 100.0 THEN 'positive' ELSE 'negative' END AS pred FROM blk b JOIN labels l USING (doc_id)),
cl AS (SELECT gold AS cls FROM pr UNION SELECT pred FROM pr),
rep AS (SELECT cl.cls,
  coalesce((SELECT count(*) FROM pr WHERE gold = cl.cls AND pred = cl.cls), 0) AS tp,
  (SELECT count(*) FROM pr WHERE pred = cl.cls) AS npred,
  (SELECT count(*) FROM pr WHERE gold = cl.cls) AS support FROM cl),
rep2 AS (SELECT cls, CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r,
  support FROM rep),
rep3 AS (SELECT cls, {r6('p')} AS precision, {r6('r')} AS recall,
  {r6('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS f1, support::BIGINT AS support FROM rep2)"""


def classification_report(spark, sf_dir):
    return E.classification_report(_predictions(spark, sf_dir))


query("classification_report", f"WITH {PRED_SQL} SELECT * FROM rep3")(classification_report)


def semeval_score(spark, sf_dir):
    return E.semeval_score(E.classification_report(_predictions(spark, sf_dir)))


query("semeval_score", f"""WITH {PRED_SQL}
SELECT {r6("(coalesce(sum(f1) FILTER (WHERE cls = 'positive'), 0) + coalesce(sum(f1) FILTER (WHERE cls = 'negative'), 0)) / 2.0")} AS semeval_f1
FROM rep3""")(semeval_score)


def _pair_sims(spark, sf_dir):
    vec = S.vectors(spark, sf_dir)
    p = S.word_pairs(spark, sf_dir)
    a = vec.select(F.col("word").alias("w1"), F.col("vec").alias("v1"))
    b = vec.select(F.col("word").alias("w2"), F.col("vec").alias("v2"))
    return p.join(a, "w1").join(b, "w2").select("w1", "w2", "score", V.cosine(F.col("v1"), F.col("v2")).alias("sim"))


PAIRS_SQL = f"""{VEC_SQL},
pairs AS (SELECT a.vec_id::VARCHAR AS w1, b.vec_id::VARCHAR AS w2, (a.label - b.label)::DOUBLE AS score
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
ps AS (SELECT p.*, list_cosine_similarity(x.vec, y.vec) AS sim FROM pairs p JOIN v x ON x.word = p.w1 JOIN v y ON y.word = p.w2)"""


def word_pair_pearson(spark, sf_dir):
    return E.pearson(_pair_sims(spark, sf_dir), "sim", "score")


query("word_pair_pearson", f"WITH {PAIRS_SQL} SELECT {r6('corr(sim, score)')} AS pearson, count(*) AS n FROM ps")(word_pair_pearson)


def word_pair_spearman(spark, sf_dir):
    return E.spearman(_pair_sims(spark, sf_dir), "sim", "score", "w1")


query("word_pair_spearman", f"""WITH {PAIRS_SQL},
rk AS (SELECT *, (rank() OVER (ORDER BY sim) + count(*) OVER (PARTITION BY sim) - 1 + rank() OVER (ORDER BY sim)) / 2.0 AS rx,
        (rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1 + rank() OVER (ORDER BY score)) / 2.0 AS ry FROM ps)
SELECT {r6('corr(rx, ry)')} AS spearman, count(*) AS n FROM rk""")(word_pair_spearman)


def simlex_vad_corr(spark, sf_dir):
    """corr(|valence difference|, pair score) over pairs joined to the VAD
    table on both words."""
    vad = S.vad(spark, sf_dir)
    p = S.word_pairs(spark, sf_dir)
    j = (p.join(vad.select(F.col("word").alias("w1"), F.col("valence").alias("v1")), "w1")
          .join(vad.select(F.col("word").alias("w2"), F.col("valence").alias("v2")), "w2")
          .select(F.abs(F.col("v1") - F.col("v2")).alias("dv"), "score"))
    return E.pearson(j, "dv", "score")


query("simlex_vad_corr", """WITH pairs AS (SELECT a.vec_id AS w1, b.vec_id AS w2, (a.label - b.label)::DOUBLE AS score,
  abs(a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE) AS dv FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT (round(corr(dv, score), 6) + 0.0) AS pearson, count(*) AS n FROM pairs""")(simlex_vad_corr)


# ---------------------------------------------------------- E10 / A16 grid

def _grid_lexicons(spark, sf_dir):
    """Three class lexicons over the vector vocabulary: label, sign of the
    first and of the second component."""
    e = S.load(spark, sf_dir, "embeddings")
    term = F.col("vec_id").cast("string").alias("term")
    sign = lambda i: F.when(F.col("embedding")[i] > 0, "positive").otherwise("negative")
    return {"label": e.select(term, F.col("label").cast("string").alias("cls")),
            "valence": e.select(term, sign(0).alias("cls")),
            "arousal": e.select(term, sign(1).alias("cls"))}


def lexicon_grid(spark, sf_dir):
    """For every train lexicon, retrofit (R1) the vectors to it, search
    neighbours, and score them against every other lexicon."""
    from lexivec.operators import retrofit as R
    vec = S.vectors(spark, sf_dir)
    lexes = _grid_lexicons(spark, sf_dir)
    out = None
    for train, tl in lexes.items():
        # Both are read more than once: the vectors as queries and rows, the neighbours for each test lexicon.
        rv = written(R.retrofit_class_vectors(vec, tl, 0.5, 0.5, 10))
        nb = written(V.knn(rv, rv, TOPN))
        for test, te in lexes.items():
            if test == train:
                continue
            s = E.summarize(E.ir_metrics(nb, te, TOPN)).select(F.lit(train).alias("train"), F.lit(test).alias("test"), "*")
            out = s if out is None else out.unionByName(s)
    return out


def _grid_sql() -> str:
    from lexivec.plans.q_vectors import LONG_SQL
    lex = {"label": "label::VARCHAR",
           "valence": "CASE WHEN embedding[1] > 0 THEN 'positive' ELSE 'negative' END",
           "arousal": "CASE WHEN embedding[2] > 0 THEN 'positive' ELSE 'negative' END"}
    ctes = [LONG_SQL, "lx AS (SELECT vec_id::VARCHAR AS term, " + ", ".join(f"{e} AS {n}" for n, e in lex.items())
            + " FROM embeddings)"]
    parts = []
    for train in lex:
        ctes.append(f"{train}_q0 AS (SELECT lv.word, lv.dim, lv.v0, lx.{train} AS cls, sz.n, lv.v0 AS q FROM lv "
                    f"JOIN lx ON lx.term = lv.word JOIN (SELECT {train} AS cls, count(*) - 1 AS n FROM lx GROUP BY 1) sz "
                    f"ON sz.cls = lx.{train})")
        for i in range(1, 11):
            p = f"{train}_q{i - 1}"
            ctes.append(f"{train}_q{i} AS (SELECT p.word, p.dim, p.v0, p.cls, p.n, CASE WHEN p.n > 0 THEN "
                        f"(p.n * 0.5 * p.v0 + 0.5 * (s.S - p.q)) / (p.n * 1.0) ELSE p.v0 END AS q FROM {p} p JOIN "
                        f"(SELECT cls, dim, sum(q) AS S FROM {p} GROUP BY cls, dim) s USING (cls, dim))")
        ctes.append(f"{train}_v AS (SELECT word, list(q ORDER BY dim) AS vec FROM {train}_q10 GROUP BY word)")
        ctes.append(f"{train}_knn AS (SELECT * FROM (SELECT a.word AS query, b.word AS word, "
                    f"row_number() OVER (PARTITION BY a.word ORDER BY list_cosine_similarity(a.vec, b.vec) DESC, b.word) AS rank "
                    f"FROM {train}_v a JOIN {train}_v b ON a.word <> b.word) WHERE rank <= {TOPN})")
        for test in lex:
            if test == train:
                continue
            t = f"{train}_{test}"
            ctes.append(f"""{t}_r AS (SELECT k.query, q.{test} AS cls, sz.num_rel, k.rank, (w.{test} = q.{test})::INTEGER AS rel
  FROM {train}_knn k JOIN lx q ON q.term = k.query JOIN lx w ON w.term = k.word
  JOIN (SELECT {test} AS cls, count(*) AS num_rel FROM lx GROUP BY 1) sz ON sz.cls = q.{test})""")
            ctes.append(f"""{t}_m AS (SELECT query, cls,
  sum(CASE WHEN rank <= 1 THEN rel ELSE 0 END) / 1.0 AS p1, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) / 5.0 AS p5,
  sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) / 10.0 AS p10,
  sum(CASE WHEN rel = 1 THEN cum_rel / rank ELSE 0 END) / any_value(num_rel) AS ap,
  coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0) AS rr,
  sum(CASE WHEN rel = 1 THEN 1.0 / log2(rank + 1.0) ELSE 0 END) /
    (SELECT sum(1.0 / log2(i + 1.0)) FROM range(1, least(any_value(num_rel), {TOPN}) + 1) t(i)) AS ndcg
  FROM (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS cum_rel FROM {t}_r) GROUP BY query, cls)""")
            means = ", ".join(f"{r6(f'avg(round({c}, 6))')} AS mean_{c}" for c in ["p1", "p5", "p10", "ap", "rr", "ndcg"])
            parts.append(f"SELECT '{train}' AS train, '{test}' AS test, {means}, count(*) AS n_queries FROM {t}_m")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


GRID_SQL = _grid_sql()
query("lexicon_grid", GRID_SQL)(lexicon_grid)


def best_model_select(spark, sf_dir):
    """For each test lexicon, the train lexicon with the best MAP."""
    return E.best_of(lexicon_grid(spark, sf_dir), "mean_ap", ["test"], ["train"])


query("best_model_select", f"""WITH g AS ({GRID_SQL})
SELECT test, arg_min(train, (-mean_ap, train)) AS train, max(mean_ap) AS best_mean_ap FROM g GROUP BY test""")(best_model_select)


def anew_sentiwn_corr(spark, sf_dir):
    """VAD table joined to a SentiWordNet-shaped table on the word;
    corr(valence, pos - neg).  The second table is the absolute 4th and 5th
    vector components."""
    vad = S.vad(spark, sf_dir)
    e = S.load(spark, sf_dir, "embeddings")
    swn = e.select(F.col("vec_id").cast("string").alias("word"), F.abs(F.col("embedding")[3]).cast("double").alias("pos"),
                   F.abs(F.col("embedding")[4]).cast("double").alias("neg"))
    j = vad.join(swn, "word").select("valence", (F.col("pos") - F.col("neg")).alias("polarity"))
    return E.pearson(j, "valence", "polarity")


query("anew_sentiwn_corr", f"""SELECT {r6('corr(embedding[1]::DOUBLE, abs(embedding[4]::DOUBLE) - abs(embedding[5]::DOUBLE))')} AS pearson,
  count(*) AS n FROM embeddings""")(anew_sentiwn_corr)


# ----------------------------------------------------- E8 affect signatures

def _signatures(spark, sf_dir):
    return E.signature_lexicon(S.affect_flags(spark, sf_dir))


SIG_SQL = """sig AS (SELECT vec_id::VARCHAR AS term,
    array_to_string(list_transform(embedding[1:4], lambda x: (x > 0)::INTEGER), '') AS cls
  FROM embeddings WHERE list_bool_or(list_transform(embedding[1:4], lambda x: x > 0)))"""
SIG_SIZES_SQL = "ssz AS (SELECT cls, count(*) - 1 AS num_rel FROM sig GROUP BY cls HAVING count(*) > 1)"


def signature_qrel(spark, sf_dir):
    return E.qrels(_signatures(spark, sf_dir), include_query=False)


query("signature_qrel", f"""WITH {SIG_SQL}, {SIG_SIZES_SQL}
SELECT s.term AS qid, 0 AS iter, s.cls, ssz.num_rel::BIGINT AS num_rel FROM sig s JOIN ssz USING (cls)""")(signature_qrel)


def _signature_metrics(spark, sf_dir):
    vec = S.vectors(spark, sf_dir)
    return E.ir_metrics(V.knn(vec, vec, TOPN), _signatures(spark, sf_dir), TOPN, include_query=False)


SIG_IR_SQL = f"""{KNN_SQL}, {SIG_SQL}, {SIG_SIZES_SQL},
r AS (SELECT k.query, q.cls, ssz.num_rel, k.rank, coalesce(w.cls = q.cls, false)::INTEGER AS rel
      FROM knn k JOIN sig q ON q.term = k.query JOIN ssz ON ssz.cls = q.cls LEFT JOIN sig w ON w.term = k.word),
{IR_METRICS_SQL}"""


def signature_ir_metrics(spark, sf_dir):
    return _signature_metrics(spark, sf_dir)


query("signature_ir_metrics", f"WITH {SIG_IR_SQL} SELECT * FROM m")(signature_ir_metrics)


def signature_ir_summary(spark, sf_dir):
    return E.summarize(_signature_metrics(spark, sf_dir))


query("signature_ir_summary", f"WITH {SIG_IR_SQL} SELECT {_MEANS}, count(*) AS n_queries FROM m")(signature_ir_summary)
