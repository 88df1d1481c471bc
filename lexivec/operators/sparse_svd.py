"""M9: truncated SVD of sparse rows by a randomised range finder.

Rows are sparse vectors ``(id, indices, values)`` of any number of columns
(:func:`lexivec.operators.dictionary.sparse_vectors`).  Rows times random signs
(a hash of the column's number, never stored) span nearly the range of the
strongest directions; products with the transpose and back sharpen it.  The
driver sees matrices of (k + oversampling)^2 numbers; what has a row per
column is a table, summed by Spark, that comes to the rows if proven small and
is joined to their entries if not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.session import DEFAULT_BROADCAST_ROWS, bounded_arrow, written

ENTRIES = 50_000  # of sparse rows at once, each with a vector of k + oversampling numbers
HELD_COLUMNS = 100_000  # sums that a task holds before it passes them on
NOISE = 1e-12  # of the greatest eigenvalue: directions below it are none
_VALUES = "array<double>"


@dataclass
class SparseSVD:
    """``components(idx, vec)``: the right singular vectors' numbers for each
    column that train rows hold; ``singular``: the values, falling."""

    components: DataFrame
    singular: np.ndarray

    def transform(self, rows: DataFrame, id_col: str = "doc_id", max_columns: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
        """``(id, components)``: rows times right singular vectors (U * S of
        train rows); columns unknown to the fit count nothing."""
        out = _times(_prepared(rows, id_col), self.components, len(self.singular), max_columns)
        return out.select(F.col("id").alias(id_col), F.col("y").alias("components"))


def fit(rows: DataFrame, k: int = 50, oversample: int = 10, iterations: int = 4, id_col: str = "doc_id", seed: int = 42, max_columns: int = DEFAULT_BROADCAST_ROWS) -> SparseSVD:
    """At most ``k`` components (as many as the rows' rank, if fewer).  Null
    values count nothing, a null or empty row is a row of zeros; an id names a
    row (it matters where a table is joined to entries)."""
    width = k + oversample
    data = written(_prepared(rows, id_col))
    found = data.mapInArrow(_by_signs(width, seed), f"id {data.schema['id'].dataType.simpleString()}, indices array<int>, values {_VALUES}, y {_VALUES}")
    for step in range(iterations + 1):
        found = written(found)
        into = _orthonormal(found, width)
        if not into.shape[1]:
            return SparseSVD(data.sparkSession.createDataFrame([], f"idx int, vec {_VALUES}"), np.zeros(0))
        sums = found.mapInArrow(_transposed(into), f"idx int, vec {_VALUES}")
        # Entries of a column are summed in the task and by Spark's partial aggregate before they move.
        columns = written(sums.groupBy("idx").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec")))
        if step < iterations:
            found = _times(data, columns, into.shape[1], max_columns)
            width = into.shape[1]
    squares, left = np.linalg.eigh(_gram(columns.select(F.col("vec").alias("y")), into.shape[1]))
    order = np.argsort(-squares)[:k]
    order = order[squares[order] > NOISE * squares.max()]
    singular = np.sqrt(squares[order])
    turned = columns.mapInArrow(_turn(left[:, order] / singular), f"idx int, vec {_VALUES}")
    return SparseSVD(written(turned), singular)


def _prepared(rows: DataFrame, id_col: str) -> DataFrame:
    cells = F.filter(F.arrays_zip("indices", "values"), lambda c: c["indices"].isNotNull() & c["values"].isNotNull())
    cells = F.coalesce(cells, F.array().cast("array<struct<indices:int,values:double>>"))
    return rows.select(F.col(id_col).alias("id"), F.transform(cells, lambda c: c["indices"].cast("int")).alias("indices"), F.transform(cells, lambda c: c["values"].cast("double")).alias("values"))


def _pieces(batch: pa.RecordBatch):
    """Parts of a batch of about ``ENTRIES`` entries: the rows, each entry's
    row in the part, its column and value."""
    sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), ENTRIES, "right")))
        part = batch.slice(at, upto - at)
        own = np.repeat(np.arange(part.num_rows), sizes[at:upto])
        yield part, own, part.column(1).flatten().to_numpy(zero_copy_only=False), part.column(2).flatten().to_numpy(zero_copy_only=False)
        at = upto


def _summed(own: np.ndarray, n: int, weighted: np.ndarray) -> np.ndarray:
    """Sums of entries' vectors by row; entries of a row stand together."""
    out = np.zeros((n, weighted.shape[1]))
    if len(own):
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[starts]] = np.add.reduceat(weighted, starts)
    return out


def _signs(columns: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A sign for each column of the data and of the sketch, by a 64-bit mix."""
    with np.errstate(over="ignore"):
        x = (columns.astype(np.uint64)[:, None] * np.uint64(width) + np.arange(width, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return 1.0 - 2.0 * ((x ^ (x >> np.uint64(31))) >> np.uint64(63)).astype(np.float64)


def _with(part: pa.RecordBatch, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(list(y), pa.list_(pa.float64()))], ["id", "indices", "values", "y"])


def _by_signs(width: int, seed: int):
    def run(batches):
        for b in batches:
            for part, own, columns, values in _pieces(b):
                yield _with(part, _summed(own, part.num_rows, _signs(columns, width, seed) * values[:, None]))
    return run


def _times(rows: DataFrame, table: DataFrame, width: int, max_columns: int) -> DataFrame:
    """Rows times ``table(idx, vec)``, as ``y`` beside them."""
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, indices array<int>, values {_VALUES}, y {_VALUES}"
    small = bounded_arrow(table, max_columns)
    if small is None:
        entries = rows.select("id", F.explode(F.arrays_zip("indices", "values")).alias("c")).select("id", F.col("c.indices").alias("idx"), F.col("c.values").alias("value"))
        met = entries.join(table, "idx").select("id", array_to_vector(F.zip_with("vec", F.array_repeat(F.col("value"), width), lambda a, v: a * v)).alias("v"))
        sums = met.groupBy(F.col("id").alias("_id")).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("y"))
        return rows.join(sums, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", "indices", "values", F.coalesce("y", F.array_repeat(F.lit(0.0), width)).alias("y"))
    order = np.argsort(keys := small["idx"].to_numpy())
    vectors = np.concatenate([np.zeros(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in small["vec"].chunks]]).reshape(len(keys), width)
    held = rows.sparkSession.sparkContext.broadcast((keys[order], vectors[order]))

    def run(batches):
        keys, vectors = held.value
        for b in batches:
            for part, own, columns, values in _pieces(b):
                at = np.minimum(np.searchsorted(keys, columns), max(len(keys) - 1, 0))
                known = keys[at] == columns if len(keys) else np.zeros(len(columns), bool)
                yield _with(part, _summed(own[known], part.num_rows, vectors[at[known]] * values[known, None]))

    return rows.mapInArrow(run, shape)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _gram(rows: DataFrame, width: int, into: np.ndarray | None = None) -> np.ndarray:
    """Sum of the products of each row's ``y`` (turned by ``into``) with itself."""
    into = np.eye(width) if into is None else into
    n = into.shape[1]

    def products(batches):
        total = np.zeros((n, n))
        for b in batches:
            y = _matrix(b, width) @ into
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    sums = rows.select("y").mapInArrow(products, f"i int, row {_VALUES}").groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    gram = np.array([r["row"] for r in sums.orderBy("i").collect()]).reshape(-1, n)
    return (gram + gram.T) / 2 if len(gram) else np.zeros((n, n))


def _orthonormal(rows: DataFrame, width: int) -> np.ndarray:
    """The matrix that makes the columns of ``y`` orthonormal, those of no
    weight left out; a second round mends the first one's rounding."""
    into = np.eye(width)
    for _ in range(2):
        values, vectors = np.linalg.eigh(_gram(rows, width, into))
        kept = values > NOISE * max(values.max(initial=0.0), 1e-300)
        into = into @ (vectors[:, kept] / np.sqrt(values[kept]))
        if not into.shape[1]:
            break
    return into


def _transposed(into: np.ndarray):
    """Columns of the data times orthonormal ``y``: each entry's value times
    its row's vector, summed by column in the task, then by Spark."""
    def run(batches):
        held, sums = np.zeros(0, np.int32), np.zeros((0, into.shape[1]))
        for b in batches:
            for part, own, columns, values in _pieces(b):
                order = np.argsort(columns, kind="stable")
                weighted = (_matrix(part, into.shape[0]) @ into)[own[order]] * values[order, None]
                new, group = np.unique(columns[order], return_inverse=True)
                merged = np.union1d(held, new)
                both = np.zeros((len(merged), into.shape[1]))
                both[np.searchsorted(merged, held)] = sums
                both[np.searchsorted(merged, new)] += _summed(group, len(new), weighted)
                held, sums = merged.astype(np.int32), both
                if len(held) > HELD_COLUMNS:
                    yield from _table(held, sums)
                    held, sums = held[:0], sums[:0]
        yield from _table(held, sums)
    return run


def _table(columns: np.ndarray, sums: np.ndarray):
    for at in range(0, len(columns), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(columns[at:at + 10_000], pa.int32()), pa.array(list(sums[at:at + 10_000]), pa.list_(pa.float64()))], ["idx", "vec"])


def _turn(into: np.ndarray):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(_matrix(b, into.shape[0]) @ into), pa.list_(pa.float64()))], ["idx", "vec"])
    return run
