"""Embedding near-dedup by cross-polytope hashing.

A fast Hadamard rotation (three rounds of random signs and the transform)
turns a vector; its hash is the axis of its largest coordinate, with its sign.
``DRAWS`` hashes make a bucket, ``TABLES`` tables are probed, and in each a
vector also enters the buckets that its next likely axes name (multiprobe).
Pairs of a bucket are verified by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.blocks import groups, in_blocks, paired
from lexivec.llm.common import in_slices
from lexivec.llm.components import components, least_labels
from lexivec.session import checkpointed

LEAST_COSINE = 0.93
TABLES = 9
DRAWS = 3
PROBES = 3  # further buckets in each table
BLOCK = 512  # vectors
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


def hashes(x: np.ndarray, tables: int = TABLES, draws: int = DRAWS, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Buckets of each row: ``(rows, tables, 1 + probes)``, its own first and
    then the likeliest others, one axis exchanged for the next best.  A number
    names its table as well: it is the table modulo ``tables``."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    random = np.random.default_rng((seed, width))
    out = np.empty((n, tables, 1 + probes), np.int64)
    near = min(width, 1 + probes)
    for t in range(tables):
        axes, gaps = [], []
        for _ in range(draws):
            turned = padded
            for _ in range(3):
                turned = hadamard(turned * random.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(turned)
            best = np.argsort(-size, axis=1, kind="stable")[:, :near]
            axes.append(2 * best + (np.take_along_axis(turned, best, 1) < 0))
            top = np.take_along_axis(size, best, 1)
            gaps.append((top[:, :1] - top[:, 1:]) ** 2)  # cost of taking the next axes instead
        place = (2 * width) ** np.arange(draws)
        own = sum(a[:, 0] * p for a, p in zip(axes, place))
        out[:, t, 0] = own
        other = np.concatenate([own[:, None] + (a[:, 1:] - a[:, :1]) * p for a, p in zip(axes, place)], axis=1)
        order = np.argsort(np.concatenate(gaps, axis=1), axis=1, kind="stable")[:, :probes]
        chosen = np.take_along_axis(other, order, 1)
        out[:, t, 1 : 1 + chosen.shape[1]] = chosen
        out[:, t, 1 + chosen.shape[1] :] = own[:, None]  # narrow vectors have fewer axes
    return out * tables + np.arange(tables)[:, None]


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Finite, non-zero vectors as doubles; None for all others."""
    out = []
    for v in column:
        v = v.as_py()
        x = None if v is None or not v or None in v else np.array(v, np.float64)
        out.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    return out


def _packed(v: np.ndarray) -> bytes:
    """The vector's bytes, as floats where they hold it exactly."""
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return (short if (short == v).all() else v).tobytes()


def _units(raw: list[bytes], width: int) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64 if len(r) == 8 * width else np.float32).astype(np.float64) for r in raw])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame, tables: int = TABLES, draws: int = DRAWS, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """``(rows, kinds)``: each row with the digest of its label and vector
    (null: it links with nothing), and one row per digest with its least
    vec_id ``rep``, the number ``n`` of its rows, the vector and its buckets."""
    out = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("label", pa.int64()), ("width", pa.int32()), ("vec", pa.binary())])
    named = pa.schema([("digest", pa.binary()), ("rep", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("vec", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels = b.column(0), b.column(1).to_pylist()
            digest, width, raw = [], [], []
            for i, label, v in zip(ids.to_pylist(), labels, _vectors(b.column(2))):
                data = None if v is None or label is None or i is None else _packed(v + 0.0)
                raw.append(data)
                width.append(None if data is None else len(v))
                digest.append(None if data is None else xxhash.xxh3_128_digest(np.array([label, len(v)], np.int64).tobytes() + data))
            yield pa.RecordBatch.from_arrays([ids, pa.array(digest, pa.binary()), b.column(1), pa.array(width, pa.int32()), pa.array(raw, pa.binary())], schema=out)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 1000):
            widths, raw = b.column(4).to_numpy(), b.column(5).to_pylist()
            buckets: list = [None] * len(raw)
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                for k, h in zip(own, hashes(_units([raw[k] for k in own], width), tables, draws, probes)):
                    buckets[k] = h.ravel()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(buckets, pa.list_(pa.int64()))], schema=named)

    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    own = slim.mapInArrow(run, "vec_id long, digest binary, label long, width int, vec binary")
    rows = checkpointed(own.select("vec_id", "digest"))
    kinds = own.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("label", "width", "vec")])
    return rows, checkpointed(kinds.mapInArrow(enter, "digest binary, rep long, n long, label long, width int, vec binary, buckets array<long>"))


def _meet_first(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Whether ``bucket`` is the first that both rows' buckets share, by table
    and then number, so that a pair counts once however many they share."""
    table = bucket % a.shape[1]
    left = np.arange(len(a))
    for t in range(table):  # most pairs of close vectors go in the first round
        left = left[~(a[left, t, :, None] == b[left, t, None, :]).any(axis=(1, 2))]
    both = np.where((a[left, table, :, None] == b[left, table, None, :]).any(axis=2), a[left, table], np.iinfo(np.int64).max)
    out = np.zeros(len(a), bool)
    out[left[both.min(axis=1) == bucket]] = True
    return out


def verified(kinds: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``(a, b, n)``: with ``n`` (``b`` null), that many rows are linked with
    ``a`` in one pair of blocks; without, ``a`` and ``b`` are connected.  Each
    link counts once; only a star of each connected part is sent on."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in groups(batches, ["label", "width", "bucket", "_i", "_j"], 4000):
            reps, sizes, buckets, widths, own, at_i, at_j = (t.column(c).to_numpy() for c in ("rep", "n", "bucket", "width", "_block", "_i", "_j"))
            vecs, lists = t.column("vec").to_pylist(), t.column("buckets").combine_chunks()
            codes = lists.flatten().to_numpy().reshape(-1, tables, 1 + probes)
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            a_out, b_out, n_out = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                first, second = np.flatnonzero(own[lo:hi] == at_i[lo]), np.flatnonzero(own[lo:hi] == at_j[lo])
                if not len(first) or not len(second):
                    continue
                x = _units(vecs[lo:hi], int(widths[lo]))
                i, j = np.nonzero(x[first] @ x[second].T >= least)
                i, j = first[i], second[j]
                if at_i[lo] == at_j[lo]:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                h = codes[lo:hi]
                keep = np.concatenate([_meet_first(h[i[k : k + 20_000]], h[j[k : k + 20_000]], int(buckets[lo])) for k in range(0, len(i), 20_000)])
                i, j = i[keep], j[keep]
                m = hi - lo
                linked = np.bincount(i, sizes[lo:hi][j], m) + np.bincount(j, sizes[lo:hi][i], m)
                some = np.flatnonzero(linked)
                label = least_labels(i, j, m)
                far = np.flatnonzero(label != np.arange(m))
                a_out += [reps[lo:hi][some], reps[lo:hi][label[far]]]
                b_out += [np.full(len(some), -1), reps[lo:hi][far]]
                n_out += [linked[some].astype(np.int64), np.full(len(far), -1)]
            if a_out:
                a, b, n = (np.concatenate(c).astype(np.int64) for c in (a_out, b_out, n_out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n >= 0), pa.array(n, mask=n < 0)], schema=out)

    # Only names meet to find the buckets that hold two or more; vectors join those entries alone.
    entries = kinds.select("rep", "label", "width", F.explode(F.array_distinct("buckets")).alias("bucket"))
    entries = entries.select("rep", F.struct("label", "width", "bucket").alias("key"))
    own = in_blocks(entries, "key", "rep", block).join(kinds.select("rep", "n", "vec", "buckets"), "rep")
    return paired(own, "key").select("rep", "n", "key.label", "key.width", "vec", "buckets", "key.bucket", "_i", "_j", "_block").mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, draws: int = DRAWS, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.

    Vectors are compared only if label and width agree.  Null labels, null or
    zero vectors and those with null or non-finite components link with
    nothing, and so do rows without vec_id (component null, not kept).  Equal
    vectors of a label are one node with their number of rows as weight.
    """
    rows, kinds = classes(vectors, tables, draws, probes)
    found = checkpointed(verified(kinds, least, tables, probes, block))
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    parted = components(found.where("n is null").select("a", "b"), kinds.select(F.col("rep").alias("node"), F.col("rep").alias("value")))
    per_kind = kinds.select("digest", "rep", "n").join(counts, "rep", "left").join(parted.withColumnRenamed("node", "rep"), "rep")
    per_kind = checkpointed(per_kind.select("digest", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.col("least").alias("component_id")))
    none = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("digest is not null").join(per_kind, "digest").select("vec_id", "n_links", "component_id").unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
