"""Corpus pipeline: documents in, token ids' digests out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the shared checkpoint folder and reads them
again as the next stage's documents, so that a lost executor costs a re-read
of one stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import bpe, lines, mixing, quality, simhash
from lexivec.llm.common import WORD, packed, table, unpacked
from lexivec.session import ensure_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.scores(packed(docs, F.col("doc_id"), F.col("text")), table(spark, sf_dir, "labels"))
    return unpacked(scored.where(F.col("_score") >= quality.CUT), docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that earlier documents hold; a document
    of which nothing is left goes."""
    whole = packed(docs, F.col("doc_id"), F.col("text"))
    cut = lines.remove_repeats(whole)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("_row.n_chars"))
    return unpacked(cut.where((F.size("_removed") == 0) | F.col("text").rlike(WORD)), docs.columns, changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix: their number, digest, and that of their decoding."""
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("substrings", remove_repeats), ("mix", mix_sources), ("bpe", encode)]

#: Trained scores, XXH64 and BPE merges have no SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
