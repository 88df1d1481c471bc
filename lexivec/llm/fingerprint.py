"""Threshold-scaled sketches of documents.

A sketch keeps every word-shingle hash below a fixed fraction of the hash
range, and nothing else, so that two sketches estimate likeness and
containment however unequal the documents are, and the sketch of a union is
the union of sketches.  The fraction is the same for every text: a text of
``n`` shingles keeps about ``n / fraction`` of them, and an estimate over
``m`` kept hashes has a standard error of about ``sqrt(j (1 - j) / m)``.  Where
short texts count, the fraction must serve them too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import batch, id_and_text, in_slices, shuffle_parts, words

SHINGLE = 5  # words
FRACTION = 8  # one hash in so many is kept
#: Of corpora with texts of a few words: all hashes lie below the threshold, so that the shortest texts keep theirs.
FRACTION_OF_SHORT_TEXTS = 1

_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                      0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's ``size``-word shingles, ascending.  Fewer
    words make one shingle of all words; no words make none."""
    if size > len(_MULTIPLY):
        raise ValueError(f"a shingle has at most {len(_MULTIPLY)} words")
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(size, len(w))
    n = len(w) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += h[i : n + i] * _MULTIPLY[i]
    return np.unique(_mixed(total))


def _threshold(fraction: int) -> np.uint64:
    return np.uint64((1 << 64) // fraction - 1)


def sketch(text: str, size: int = SHINGLE, fraction: int = FRACTION) -> np.ndarray:
    h = shingle_hashes(text, size)
    return h[: int(np.searchsorted(h, _threshold(fraction), "right"))]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both documents together; both are of one fraction."""
    return np.union1d(a, b)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of all shingles that both have; two empty sketches: 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; an empty ``a``: 1."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def to_string(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, size: int = SHINGLE, fraction: int = FRACTION) -> DataFrame:
    """``doc_id, fingerprint`` for each row of ``docs``; no shuffle."""
    out = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 1000):
            yield batch(out, [(i, to_string(sketch(t, size, fraction))) for i, t in zip(*(c.to_pylist() for c in b.columns))])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _range_of(marks: list[tuple[int, int]]):
    """Pandas UDF (key, hash) -> number of marks that are not above it."""
    keys, hashes = (np.array(c, np.int64) for c in (zip(*marks) if marks else ((), ())))

    def found(key: pd.Series, h: pd.Series) -> pd.Series:
        k, x = key.to_numpy(), h.to_numpy()
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for at in np.unique(lo[hi > lo]):  # a key with marks of its own is cut by the hash
            own = (lo == at) & (hi > lo)
            lo[own] = at + np.searchsorted(hashes[at : hi[own][0]], x[own], "right")
        return pd.Series(lo.astype(np.int32))

    return F.pandas_udf(found, "int")


def _in_order(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` dealt to ranges of descending doc_id and text hash and sorted
    within, each range ending with a copy (``_after``) of the row that follows
    it, so that neighbours meet in one task.  One shuffle of the texts.

    Ranges are cut at marks of a sample of keys, about a hundred for each of
    the ``n`` ranges and so bounded by it; a repeated or null id is cut by the
    text hash like any other.  Rows that agree in id and text share a range.
    """
    spark = docs.sparkSession
    # ~id falls as the id rises; null ids come after all others.
    keyed = docs.select("doc_id", "text", F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1)).alias("_k"), F.xxhash64("text").alias("_h"))
    every = max(1, docs.count() // (100 * n))
    sample = sorted((r["_k"], r["_h"]) for r in keyed.where(F.pmod(F.xxhash64("_k", "_h"), F.lit(every)) == 0).select("_k", "_h").distinct().collect())
    marks = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    ranged = keyed.withColumn("_range", _range_of(marks)("_k", "_h"))
    heads = sorted((r["_range"], *r["head"]) for r in ranged.groupBy("_range").agg(F.min(F.struct("_k", "_h")).alias("head")).collect())  # at most n rows
    before = [(*heads[i], heads[i - 1][0]) for i in range(len(heads))]  # the first range's head follows the last range
    follows = ranged.join(F.broadcast(spark.createDataFrame(before, "_range int, _k long, _h long, _to int")), ["_range", "_k", "_h"])
    follows = follows.groupBy("_to").agg(F.first(F.struct("doc_id", "text")).alias("_row"))
    both = ranged.select("_range", F.lit(False).alias("_after"), "doc_id", "text").unionByName(
        follows.select(F.col("_to").alias("_range"), F.lit(True).alias("_after"), "_row.doc_id", "_row.text"))
    return both.repartition(shuffle_parts(docs), "_range").sortWithinPartitions("_range", "_after", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


def edited_likeness(docs: DataFrame, n_ranges: int | None = None, fraction: int = FRACTION_OF_SHORT_TEXTS) -> DataFrame:
    """Fingerprint of each text, of its edited text (its last half replaced by
    the start of the next document's), and the likeness of the two and of the
    next document's.  "Next" is by descending doc_id, null ids last, ties by a
    hash of the text, and the first follows the last.

    Null text: empty.  Repeated rows: each is a document and follows its twin;
    rows that agree in id and text share one task, other rows of an id (null
    ones too) are dealt to many.  A text is held whole, with the one before it.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next document is still to come
        for b in in_slices(batches, 500):
            rows = []
            for _, after, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                own = sketch(text, fraction=fraction)
                if held is not None:
                    at, was, mine = held
                    half = len(was) // 2
                    edited = was[: len(was) - half] + text[:half]
                    new = sketch(edited, fraction=fraction)
                    rows.append((at, len(was), hashlib.sha256(edited.encode()).hexdigest(), to_string(mine), to_string(new), likeness(mine, new), likeness(mine, own)))
                held = None if after else (doc, text, own)
            yield batch(out, rows)

    docs = id_and_text(docs)
    return _in_order(docs, n_ranges or 4 * shuffle_parts(docs)).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
