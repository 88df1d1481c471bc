"""Sinks (K1-K9): the reference's text outputs and result caching.

Writers are distributed (one file per partition); formats follow the
reference's line layouts.  :func:`materialize` replaces pickle/gensim caches
with a Parquet table plus a freshness check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """K3: lines ``word v1 v2 ...`` with ``%.4f`` components."""
    line = F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vec", lambda x: F.format_string("%.4f", x)), " "))
    vectors.select(line.alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, cols: list[str], path: str, sep: str = " ") -> None:
    """K4/K6/K7: space-joined lines (inequalities, corpus, synonym lists)."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]).alias("value")).write.mode("overwrite").text(path)


def write_class_lists(pieces: DataFrame, path: str) -> None:
    """K7: lines ``cls<TAB>piece<TAB>terms`` of a lexicon's numbered pieces
    (``lexicon.invert``), over the files in class and piece order."""
    lines = pieces.select("cls", "piece", F.array_join("terms", " ").alias("line")).sort("cls", "piece")
    lines.select(F.concat_ws("\t", "cls", F.col("piece").cast("string"), "line").alias("value")).write.mode("overwrite").text(path)


def write_tweet_log(tweets: DataFrame, path: str) -> None:
    """S14's lines of ``(tweet_id, text)``: two tuples parted by a tab, the
    text as a string literal without control characters."""
    text = F.coalesce("text", F.lit(""))
    for sign, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(escaped))
    line = F.concat(F.lit("('id', u'"), F.col("tweet_id").cast("string"), F.lit("')\t('text', u'"), text, F.lit("')"))
    tweets.select(line.alias("value")).where(F.col("value").isNotNull()).write.mode("overwrite").text(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """K5: ``word<TAB>count``, frequency-descending within the sorted output."""
    vocab.orderBy(F.col("cnt").desc(), F.col("word")).write.mode("overwrite").option("sep", "\t").csv(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    """K8: TREC qrel lines ``qid iter docno rel``; judgments in implicit form
    (``evaluate.qrels``) are written as ``qid iter cls num_rel``."""
    explicit = {"docno", "rel"} <= set(qrels.columns)
    write_lines(qrels, ["qid", "iter", "docno", "rel"] if explicit else ["qid", "iter", "cls", "num_rel"], path)


def write_run(run: DataFrame, path: str) -> None:
    """K8: TREC run lines ``qid iter docno rank sim runid``."""
    write_lines(run, ["qid", "iter", "docno", "rank", "sim", "runid"], path)


def write_predictions(pred: DataFrame, path: str) -> None:
    """K9: ``sid<TAB>label``."""
    pred.select("sid", "label").write.mode("overwrite").option("sep", "\t").csv(path)


def _mtime(spark: SparkSession, path: str):
    """Latest file modification time under ``path`` (None if missing), read
    through the ``binaryFile`` source's metadata columns (content is pruned)."""
    from pyspark.errors import AnalysisException
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.agg(F.max("modificationTime")).first()[0]
    except AnalysisException:
        return None


def materialize(spark: SparkSession, path: str, build, sources: list[str] | None = None, force: bool = False) -> DataFrame:
    """K1/K2: return the Parquet table at ``path``, (re)building it with
    ``build() -> DataFrame`` when missing, forced, or older than any source."""
    have = _mtime(spark, path)
    stale = have is None or force
    if not stale and sources:
        times = [_mtime(spark, s) for s in sources]
        stale = any(t is not None and t > have for t in times)
    if stale:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
