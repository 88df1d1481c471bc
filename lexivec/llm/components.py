"""Connected components by contraction, as Spark joins and aggregates.

Each round, every task first turns the edges it has into stars around the
node of least random priority; then every node points at the neighbour (or
itself) of least priority, and edges are rewritten to what their ends point
at.  Priorities change each round, so chains and stars shrink by a constant
factor in expectation and the rounds are logarithmic.  Nothing is gathered in one task
or on the driver, and each round's tables are reliable checkpoints, so that a
lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.session import checkpointed


def least_labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For links ``i[k] - j[k]`` among ``n`` nodes: the least index that each
    node can reach."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _stars(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Edges ``a, b`` with their ends' priorities ``pa, pb``, as stars of each
    ``rows`` edges."""
    def star(t: pa.Table) -> pa.RecordBatch:
        a, b, first_a, first_b = (t.column(k).to_numpy() for k in range(4))
        node, first, at = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
        order = np.argsort(np.concatenate([first_a, first_b])[first], kind="stable")
        rank = np.empty(len(node), np.int64)
        rank[order] = np.arange(len(node))
        label = least_labels(rank[at[: len(a)]], rank[at[len(a) :]], len(node))
        far = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[order[label[far]]]), pa.array(node[order[far]])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield star(pa.Table.from_batches(held))
            held = []
    if held:
        yield star(pa.Table.from_batches(held))


def components(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``(node, least)`` for every node of ``values``: the least ``value``
    (nulls ignored) over all nodes it is connected with.

    ``edges(a, b)``: longs, any order, repeats and self-links allowed.
    ``values(node, value)``: one row per node.  A node without edges keeps its
    own value; edges of nodes that ``values`` lacks connect all the same.
    """
    live = checkpointed(edges.where("a <> b").select("a", "b"), few=True)
    levels = []
    value = values.select("node", "value")
    while not live.isEmpty():
        seed = F.lit(len(levels))
        stars = live.select("a", "b", F.xxhash64("a", seed).alias("pa"), F.xxhash64("b", seed).alias("pb")).mapInArrow(_stars, "a long, b long")
        live = checkpointed(stars.distinct(), few=True)
        sides = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        best = sides.groupBy("node").agg(F.min(F.struct(F.xxhash64("other", seed).alias("p"), F.col("other"))).alias("best"))
        own = F.struct(F.xxhash64("node", seed).alias("p"), F.col("node").alias("other"))
        to = checkpointed(best.select("node", F.least("best", own)["other"].alias("parent")), few=True)
        levels.append((to, value))
        value = value.join(to, "node", "left").groupBy(F.coalesce("parent", "node").alias("node")).agg(F.min("value").alias("value"))
        value = checkpointed(value, few=True)
        ends = live.join(to.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").join(
            to.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        live = checkpointed(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), few=True)
    for to, before in reversed(levels):
        up = before.join(to, "node", "left").select("node", F.coalesce("parent", "node").alias("parent"))
        value = checkpointed(up.join(value.withColumnRenamed("node", "parent"), "parent", "left").select("node", "value"), few=True)
    return value.withColumnRenamed("value", "least")
