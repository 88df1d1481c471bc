"""N-gram embeddings and a logistic layer over their mean, trained together.

N-grams are hashed to ``buckets`` rows of a table, so the model's size is a
parameter (buckets x dim numbers) whatever the corpus.  An epoch is one pass:
each of a few workers runs mini-batches over its rows from the same broadcast
model and returns what it changed; Spark sums the changes by row and the
driver takes their mean, weighted by the batches that touched the row.  Only
the model passes the driver, never a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.session import written

BUCKETS = 1 << 16
WORKERS = 64  # more return more changes of the same rows than they save time
ROWS_OF_A_WORKER = 4_000  # at least: with fewer its mini-batches are too few between two means
HEAD = -1  # the row of the logistic layer: its weights, then its bias


@dataclass
class NgramModel:
    """``table`` holds a vector per bucket, ``weights`` and ``bias`` the
    logistic layer over a document's mean vector."""

    table: np.ndarray
    weights: np.ndarray
    bias: float
    n: int

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"row": np.arange(HEAD, len(self.table)), "n": np.full(len(self.table) + 1, self.n),
                         "vec": pa.array([np.append(self.weights, self.bias), *self.table], pa.list_(pa.float64()))})
        spark.createDataFrame(rows).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NgramModel:
        rows = spark.read.parquet(path).orderBy("row").toArrow().combine_chunks()
        head = np.array(rows["vec"][0].as_py())
        return NgramModel(np.array(rows["vec"][1:].to_pylist()), head[:-1], float(head[-1]), rows["n"][0].as_py())


def hashed_ngrams(toks: Column, n: int, buckets: int) -> Column:
    """Bucket numbers of all n-grams of 1 to ``n`` tokens, repeats included."""
    grams = F.concat(*[T.ngrams(toks, i) for i in range(1, n + 1)])
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int"))


def _shares(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that some documents hold, and each one's share of each
    document's n-grams (documents x buckets)."""
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    held, at = np.unique(ids.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    cells = np.repeat(np.arange(len(counts)), counts) * len(held) + at
    found = np.bincount(cells, minlength=len(counts) * len(held)).reshape(len(counts), len(held))
    return held, found / np.maximum(counts, 1)[:, None]


def _probability(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class _Adam:
    """Adaptive steps for the rows a batch touches."""

    def __init__(self, shape, rate: float):
        self.mean, self.square, self.rate = np.zeros(shape), np.zeros(shape), rate
        self.steps = np.zeros(shape[0])

    def step(self, rows, gradient):
        self.steps[rows] += 1
        # Each table is read and written once; what is read is worked on in place.
        mean, square = self.mean[rows], self.square[rows]
        mean *= 0.9
        mean += 0.1 * gradient
        self.mean[rows] = mean
        square *= 0.999
        square += 0.001 * gradient**2
        self.square[rows] = square
        t = self.steps[rows][:, None]
        mean /= 1 - 0.9**t
        mean *= self.rate
        square /= 1 - 0.999**t
        np.sqrt(square, out=square)
        square += 1e-8
        mean /= square
        return mean


def fit(docs: DataFrame, toks: Column, target: Column, n: int = 2, dim: int = 50, epochs: int = 5, batch: int = 32, rate: float = 0.05,
        buckets: int = BUCKETS, workers: int = WORKERS, seed: int = 42) -> NgramModel:
    """Binary cross-entropy on ``target`` (0 or 1; rows without one take no
    part), Adam, ``epochs`` passes of mini-batches of ``batch`` documents.

    A null or empty token array is a document without n-grams (mean zero).
    Without any row the model is as it starts: every score one half."""
    spark = docs.sparkSession
    rows = docs.select(hashed_ngrams(F.coalesce(toks, F.array().cast("array<string>")), n, buckets).alias("ids"), target.cast("double").alias("y")).where(F.col("y").isNotNull())
    data = written(rows)
    workers = max(1, min(workers, -(-data.count() // ROWS_OF_A_WORKER)))
    # Dealt evenly whatever the rows are, each worker's in an order that has nothing to do with labels.
    data = written(data.repartition(workers).sortWithinPartitions(F.xxhash64("ids"))).coalesce(workers)
    model = NgramModel(np.random.default_rng(seed).uniform(-0.05, 0.05, (buckets, dim)), np.random.default_rng(seed + 1).uniform(-0.3, 0.3, dim), 0.0, n)
    for _ in range(epochs):
        held = spark.sparkContext.broadcast(model)
        changes = data.mapInArrow(_epoch(held, batch, rate), "row int, change array<double>")
        summed = changes.groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("change"))).alias("change")).toArrow().combine_chunks()
        model = _moved(model, summed)
        held.unpersist()
    return model


def _moved(model: NgramModel, summed: pa.Table) -> NgramModel:
    """The model with the mean change of each row added."""
    table, weights, bias = model.table.copy(), model.weights, model.bias
    for is_head in (False, True):
        part = summed.filter(pc.equal(pc.equal(summed["row"], HEAD), is_head)).combine_chunks()
        if not part.num_rows:
            continue
        sums = part["change"].chunk(0).flatten().to_numpy().reshape(part.num_rows, -1)
        steps = sums[:, :-1] / sums[:, -1:]
        if is_head:
            weights, bias = weights + steps[0, :-1], bias + float(steps[0, -1])
        else:
            table[part["row"].to_numpy()] += steps
    return NgramModel(table, weights, bias, model.n)


def _epoch(held, batch: int, rate: float):
    """One worker's pass: what it changed, times the mini-batches that did so,
    and their number.  Rows stream by; the model alone is held."""
    def run(batches):
        start = held.value
        table, weights, bias = start.table.copy(), start.weights.copy(), start.bias
        rows, head = _Adam(table.shape, rate), _Adam((1, len(weights) + 1), rate)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                piece = b.slice(at, batch)
                buckets, share = _shares(piece.column(0))
                y = piece.column(1).to_numpy()
                means = share @ table[buckets]
                slope = (_probability(means @ weights + bias) - y) / len(y)
                step = head.step(np.array([0]), np.append(means.T @ slope, slope.sum())[None, :])[0]
                table[buckets] -= rows.step(buckets, (share.T @ slope)[:, None] * weights)
                weights, bias = weights - step[:-1], bias - step[-1]
        if not head.steps[0]:
            return
        touched = np.flatnonzero(rows.steps)
        changes = np.column_stack([(table - start.table)[touched] * rows.steps[touched, None], rows.steps[touched]])
        own = np.append(weights - start.weights, bias - start.bias) * head.steps[0]
        for at in range(0, len(touched), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(touched[at:at + 4096].astype(np.int32)), pa.array(list(changes[at:at + 4096]), pa.list_(pa.float64()))], ["row", "change"])
        yield pa.RecordBatch.from_arrays([pa.array([HEAD], pa.int32()), pa.array([np.append(own, head.steps[0])], pa.list_(pa.float64()))], ["row", "change"])
    return run


def score(docs: DataFrame, toks: Column, model: NgramModel, id_col: str = "doc_id", batch: int = 32) -> DataFrame:
    """``(id, score)``: the probability of target 1; a document without
    n-grams gets that of the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    listed = F.coalesce(toks, F.array().cast("array<string>"))
    asked = docs.select(F.col(id_col), hashed_ngrams(listed, model.n, len(model.table)).alias("ids"))

    def scores(batches):
        m = held.value
        for b in batches:
            for at in range(0, b.num_rows, batch):
                piece = b.slice(at, batch)
                buckets, share = _shares(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(_probability(share @ (m.table[buckets] @ m.weights) + m.bias))], [id_col, "score"])

    return asked.mapInArrow(scores, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
