"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space as the contracts name it: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are wide, and a worker holds a batch whole.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to ``BATCH_ROWS`` if it has
    more, so that a worker's memory doesn't follow the texts' length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null text: empty); extra columns are left out,
    so clashing names cannot reach an operator's own columns."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def words(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased: ``bytes.lower`` and ``bytes.split``
    treat ASCII letters and ASCII white space only, as the contracts ask."""
    return text.encode("utf-8").lower().split()


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``; empty batches are skipped."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def packed(docs: DataFrame, *own: Column) -> DataFrame:
    """Whole rows of ``docs`` as the struct ``_row`` beside an operator's own
    columns, so that no name of theirs can clash; :func:`unpacked` undoes it."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *own)


def unpacked(df: DataFrame, columns: list[str], changed: dict[str, Column] | None = None, *more: Column) -> DataFrame:
    """The named columns of ``_row``, some of them changed, then ``more``."""
    changed = changed or {}
    return df.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in columns], *more)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def plain_key(c: Column) -> Column:
    """``c`` with the greatest long for null, as a plain join key."""
    return F.coalesce(c, F.lit(2**63 - 1))
