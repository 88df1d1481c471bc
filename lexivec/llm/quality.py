"""Quality scores by votes of the nearest labelled documents.

Documents become hashed counts of byte trigrams, weighted by how rare a
trigram is among the labelled sample, beside the shares of words that repeat
one shortly before, and are projected onto the sample's
leading singular vectors (latent semantics).  The labelled vectors, at most
``2 * PER_LABEL`` of them, are broadcast; every document meets all of them in
blocks of exact cosines, and its ``NEIGHBOURS`` nearest vote with their
similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import id_and_text, in_slices

PER_LABEL = 1500  # labelled documents of each label in the sample; the bound of the fit
WIDTH = 4096  # hashed trigrams
RANK = 48  # latent dimensions
LAGS = 4  # words back to look for repeats
REPEAT_WEIGHT = 2.0  # of a share of repeats beside the unit vector of trigrams
NEIGHBOURS = 25
SHARPNESS = 4  # power of the similarity that weighs a vote
CUT = 0.3


def features(text: str) -> np.ndarray:
    """Log counts of the text's hashed byte trigrams, then for each lag the
    share of words equal to the one that many before."""
    out = np.zeros(WIDTH + LAGS, np.float32)
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(b) >= 3:
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        at = (code * np.uint32(2654435761)) >> np.uint32(33 - WIDTH.bit_length())
        out[:WIDTH] = np.log1p(np.bincount(at, minlength=WIDTH))
    w = text.split()
    for lag in range(1, min(LAGS, len(w) - 1) + 1):
        out[WIDTH + lag - 1] = sum(map(eq, w, islice(w, lag, None))) / (len(w) - lag)
    return out


def weighed(x: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rows of :func:`features`, the trigrams as unit vectors by rarity."""
    return np.concatenate([_unit(x[:, :WIDTH] * rarity), REPEAT_WEIGHT * x[:, WIDTH:]], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


@dataclass
class Voters:
    """The fitted classifier; its size is bounded by the sample's."""
    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    usual: float  # score of a text without a neighbour: the sample's share of label 1

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.usual)
        if not len(self.vectors):
            return out
        x = weighed(np.stack([features(t) for t in texts]), self.rarity)
        like = _unit(x @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, like.shape[1])
        near = np.argpartition(-like, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(like, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        some = total > 0
        out[some] = (weight * self.good[near]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0, 1)


def fit(counts: np.ndarray, good: np.ndarray, rank: int = RANK) -> Voters:
    """Voters from the sample's features and labels (0 or 1)."""
    n = len(counts)
    if not n:
        return Voters(np.ones(WIDTH, np.float32), np.zeros((WIDTH + LAGS, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), 0.5)
    rarity = (np.log((1 + n) / (1 + (counts[:, :WIDTH] > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weighed(counts, rarity)
    width = x.shape[1]
    k = min(rank, n, width)
    # Randomised subspace iteration, seeded: a few products instead of a full decomposition.
    basis = np.random.default_rng(0).standard_normal((width, min(k + 16, n, width))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ right.T)[:, :k].astype(np.float32)
    return Voters(rarity, axes, _unit(x @ axes), good.astype(np.float64), float(good.mean()))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample: of each label the
    ``per_label`` documents of least hash of their id that are not held out.
    A document with several labels has the greatest; null labels are none."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    per_doc = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("quality"))
    known = per_doc.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = known.where("quality = 0").orderBy(*order).limit(per_label).unionByName(known.where("quality = 1").orderBy(*order).limit(per_label))
    rows = drawn.collect()  # at most 2 * per_label ids
    if not rows:
        return np.zeros((0, WIDTH + LAGS), np.float32), np.zeros(0)
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], r["quality"]) for r in rows], "doc_id long, quality int")
    out = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 200):
            counts = [features(t).astype(np.float16).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.binary())], schema=out)

    texts = id_and_text(docs).join(F.broadcast(wanted), "doc_id").select("doc_id", "quality", "text")
    # One row per drawn id, whatever rows repeat it: 2 * per_label * 8 KB at most.
    got = texts.mapInArrow(run, "doc_id long, quality int, counts binary").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("counts").alias("counts")).toPandas().sort_values("doc_id")
    return np.stack([np.frombuffer(c, np.float16) for c in got["counts"]]).astype(np.float32), got["quality"].to_numpy()


def scores(docs: DataFrame, labels: DataFrame, cut: float = CUT, per_label: int = PER_LABEL) -> DataFrame:
    """All columns of ``docs`` and ``_score`` (0 to 1, higher: label 1 is
    likelier).  Texts under three bytes, null texts and empty label tables get
    the sample's share of label 1 (0.5 without a sample)."""
    voters = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, per_label)))

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            parts = [voters.value.scores(texts[at : at + 500].to_pylist()) for at in range(0, len(texts), 500)]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    score = F.arrow_udf(run, "double")
    return docs.withColumn("_score", score(F.coalesce(F.col("text").cast("string"), F.lit(""))))
