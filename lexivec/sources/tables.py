"""Driver tables and the inputs derived from them.

The reference reads lexicons and vector files from disk; on the driver data
those inputs are derived deterministically from the given tables (see
FIXTURES.md part B), with the same definitions in Spark and in the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.session import is_local

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Tables whose per-row work dominates (long texts, vectors).
HEAVY = {"documents", "conversations", "pages", "embeddings"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (parquet: column pruning and filter pushdown apply).

    On a local master heavy tables are spread to the default parallelism when
    the scan yields fewer splits (e.g. one parquet row group).
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def spread(df: DataFrame) -> DataFrame:
    """On a local master, round-robin repartition where the input has too few
    partitions; a cluster's scans are left as they are."""
    if not is_local(df.sparkSession.sparkContext.master):
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def documents(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical + numeric lexicon ``(term, cls, score)`` from ``benchmark``.

    Distinct lower-cased, whitespace-collapsed tokens matching ``^[a-z]{2,}$``;
    ``cls`` is positive for even length, else negative; ``score=(len-5)/5``.
    """
    b = load(spark, sf_dir, "benchmark").select(F.explode(T.tokens("text")).alias("term"))
    return (b.where(F.col("term").rlike("^[a-z]{2,}$")).distinct()
             .select("term",
                     F.when(F.length("term") % 2 == 0, F.lit("positive")).otherwise(F.lit("negative")).alias("cls"),
                     ((F.length("term") - 5) / 5.0).alias("score")))


def bigram_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram lexicon ``(term, score)``: distinct adjacent pairs of lexicon-shaped
    tokens of ``benchmark``; ``score=(len(term)-10)/10``."""
    toks = load(spark, sf_dir, "benchmark").select(T.tokens("text").alias("t"))
    pairs = toks.select(F.explode(T.ngrams("t", 2)).alias("term"))
    return (pairs.where(F.col("term").rlike("^[a-z]{2,} [a-z]{2,}$")).distinct()
                 .select("term", ((F.length("term") - 10) / 10.0).alias("score")))


def pair_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair lexicon ``(term, left, right, score)`` with ``term = left---right``:
    each bigram ``a b`` of the bigram lexicon gives the unigram pair ``a---b``."""
    bl = bigram_lexicon(spark, sf_dir)
    parts = F.split("term", " ")
    return (bl.select(parts[0].alias("left"), parts[1].alias("right"), "score")
              .groupBy("left", "right").agg(F.max("score").alias("score"))
              .select(F.concat_ws("---", "left", "right").alias("term"), "left", "right", "score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors ``(word, vec ARRAY<DOUBLE>)``: ``vec_id`` plays the word."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("word"),
                    F.col("embedding").cast("array<double>").alias("vec"))


def vector_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class lexicon over the vector vocabulary: ``(term, cls)`` from ``label``."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("term"), F.col("label").cast("string").alias("cls"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonym graph ``(src, dst)``: next and previous ``vec_id`` within a label."""
    from lexivec.operators.ordering import successors
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    nxt = successors(e, "label", "vec_id", [1]).where(F.col("vec_id_1").isNotNull())
    fwd = nxt.select(F.col("vec_id").alias("a"), F.col("vec_id_1").alias("b"))
    out = fwd.select(F.col("a").alias("s"), F.col("b").alias("d")).union(fwd.select(F.col("b").alias("s"), F.col("a").alias("d")))
    return out.select(F.col("s").cast("string").alias("src"), F.col("d").cast("string").alias("dst"))


def vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valence/arousal/dominance table: first three components of each vector."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("word"),
                    F.col("embedding")[0].cast("double").alias("valence"),
                    F.col("embedding")[1].cast("double").alias("arousal"),
                    F.col("embedding")[2].cast("double").alias("dominance"))


def affect_flags(spark: SparkSession, sf_dir: str, n_affects: int = 4) -> DataFrame:
    """NRC-style affect flags ``(word, flags ARRAY<INT>)``: one 0/1 flag per
    affect, 1 where the vector component is positive (first ``n_affects``)."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("word"),
                    F.transform(F.slice("embedding", 1, n_affects), lambda x: (x > 0).cast("int")).alias("flags"))


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human-score stand-in ``(w1, w2, score)``: ``vec_id``, ``vec_id+1``, label difference."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("label2"))
    j = e.join(b, "vec_id")
    return j.select(F.col("vec_id").cast("string").alias("w1"), (F.col("vec_id") + 1).cast("string").alias("w2"),
                    (F.col("label") - F.col("label2")).cast("double").alias("score"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word clusters ``(word, cluster)``: lexicon terms, cluster = first letter."""
    return lexicon(spark, sf_dir).select(F.col("term").alias("word"), F.substring("term", 1, 1).alias("cluster"))


def pos_tag(tok, names: tuple[str, str, str] = ("S", "M", "L")) -> "F.Column":
    """Stand-in part-of-speech tag: token length class, short (<=3), medium (<=6), long."""
    c = F.col(tok) if isinstance(tok, str) else tok
    n = F.length(c)
    short, medium, long = map(F.lit, names)
    return F.when(n <= 3, short).when(n <= 6, medium).otherwise(long)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled corpus in the reference's dataset shape:
    ``(sid, uid, label, text)`` with gold label from ``labels.quality``."""
    d = documents(spark, sf_dir)
    lab = load(spark, sf_dir, "labels")
    return (d.join(lab, "doc_id")
             .select(F.col("doc_id").cast("string").alias("sid"), F.col("source").alias("uid"),
                     F.when(F.col("quality") == 1, F.lit("positive")).otherwise(F.lit("negative")).alias("label"),
                     "text", "lang", "doc_id"))
