"""SimHash near-dedup with BK-trees.

Two fingerprints within ``radius`` bits agree on at least ``parts - radius``
of ``parts`` bit ranges, so every choice of that many ranges is a shard key,
and linked fingerprints share a shard.  Each shard, cut into blocks where it
is large, gets a BK-tree: a node's children are keyed by their Hamming
distance to it, and a search at distance d follows the edges from d - radius
to d + radius.  A tree goes to the query blocks of its own shard only: a
broadcast of all trees would pass every fingerprint through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.blocks import block_pairs, groups
from lexivec.llm.common import id_and_text, in_slices, packed, plain_key, text_hash, unpacked, words
from lexivec.llm.components import components, least_labels
from lexivec.session import checkpointed

SHINGLE = 4  # words
RADIUS = 4  # differing bits
SEED = 42
PARTS = 6
BLOCK = 512  # fingerprints of a tree


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if over half of the shingles'
    XXH64 have it.  Fewer words make one shingle; no words: 0."""
    w = words(text)
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[len(w) - n :].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), ">u8", n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        total += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp`` (the fingerprint's bits as a signed long)."""
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 1000):
            fp = np.array([fingerprint(t, size) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], schema=out)

    slim = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long")


class BkForest:
    """BK-trees of many groups at once, as arrays.

    ``fp`` holds the members and ``group`` the group of each, out of
    ``n_groups``; a group's first member is its root.  Levels are built and
    searched together.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray, n_groups: int):
        self.fp, self.root = fp, np.full(n_groups, -1)
        have, first = np.unique(group, return_index=True)
        self.root[have] = first
        at = self.root[group]
        rest = np.flatnonzero(at != np.arange(len(fp)))
        at = at[rest]
        edges, children = [], []
        while len(rest):
            edge = at * 65 + np.bitwise_count(fp[rest] ^ fp[at])
            key, first, back = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(key)
            children.append(rest[first])
            at = rest[first][back]
            more = at != rest
            rest, at = rest[more], at[more]
        edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], (np.concatenate(children)[order] if children else np.empty(0, np.int64))

    def search(self, query: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, member index) within ``radius``; a query visits
        its group's tree only."""
        found = []
        for lo in range(0, len(query), 4096):
            q = np.arange(lo, min(lo + 4096, len(query)))
            node = self.root[group[q]]
            while len(q):
                d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
                hit = d <= radius
                found.append((q[hit], node[hit]))
                first = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
                n = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right") - first
                q = np.repeat(q, n)
                node = self.child[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(q))]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def shard_keys(fp: F.Column, radius: int, parts: int) -> F.Column:
    """Array of shard keys of a fingerprint, one for each choice of ranges."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = [sum(masks[i] for i in c) for c in combinations(range(parts), parts - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in signed]
    return F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])


def links(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: enough links between distinct fingerprints ``fp`` to join
    all that are within ``radius`` bits of each other, directly or through
    others; within a pair of blocks only a star of each connected part is
    sent on, not all its pairs."""
    if parts <= radius:
        raise ValueError("more ranges than differing bits are needed")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    by = ["shard", "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in groups(batches, ["choice", "bits", "_i", "_j"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            i, j, own = (t.column(c).to_numpy() for c in ("_i", "_j", "_block"))
            tree = np.flatnonzero(own == i)  # the trees hold the first block's members, the second's ask
            forest = BkForest(fp[tree], group[tree], int(group[-1]) + 1)
            asks = np.flatnonzero((own == j) & (forest.root[group] >= 0))
            q, m = forest.search(fp[asks], group[asks], radius)
            x, y = asks[q], tree[m]
            some = x != y
            label = least_labels(x[some], y[some], len(fp))
            far = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[label[far]].view(np.int64)), pa.array(fp[far].view(np.int64))], schema=out)

    members = fps.select("fp", F.explode(shard_keys(F.col("fp"), radius, parts)).alias("shard"))
    dealt = block_pairs(members, "shard", "fp", block)
    return dealt.select("shard.choice", "shard.bits", "fp", "_i", "_j", "_block").mapInArrow(run, "a long, b long")


def _parted(own: DataFrame, value: F.Column, radius: int, parts: int, block: int) -> DataFrame:
    """``(node, least)``: the least ``value`` of each fingerprint's component."""
    nodes = checkpointed(own.groupBy("fp").agg(F.min(value).alias("value")))
    return components(links(nodes, radius, parts, block), nodes.withColumnRenamed("fp", "node"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` for each row of ``docs``.

    ``component_id``: the least doc_id among all documents that links reach
    (null ids are not least unless alone).  Null text: empty, fingerprint 0.
    Equal fingerprints are one node, so copies cost one row, however many.
    """
    own = checkpointed(fingerprints(docs, size))
    parted = _parted(own, F.col("doc_id"), radius, parts, block)
    return own.join(parted.select(F.col("node").alias("fp"), F.col("least").alias("component_id")), "fp").select("doc_id", "text_hash", "fp", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component: that of least doc_id (null
    last), then of least text hash; of rows that agree in both, one."""
    own = checkpointed(fingerprints(docs, size))
    rank = F.struct(F.col("doc_id").isNull().alias("_no_id"), plain_key(F.col("doc_id")).alias("_key"), F.col("text_hash").alias("_hash"))
    # Equal doc_id and text have one fingerprint, so no two components share their least.
    first = _parted(own, rank, radius, PARTS, BLOCK).select("least.*").distinct()
    doc_id = F.col("doc_id").cast("long")
    here = packed(docs, doc_id.isNull().alias("_no_id"), plain_key(doc_id).alias("_key"), text_hash(F.col("text")).alias("_hash"))
    by = ["_no_id", "_key", "_hash"]
    return unpacked(here.join(first, by, "left_semi").dropDuplicates(by), docs.columns)
