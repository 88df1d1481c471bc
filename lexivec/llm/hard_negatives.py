"""Hard negatives by rotated one-bit codes and exact integer scores.

Vectors are integers; a score is their inner product.  ``ROTATIONS`` random
orthogonal matrices, one below the other, turn a vector into a longer one
whose signs are its code.  Turned back, the code is a vector ``s``; its
alignment with the coded vector is stored: ``x = gain * s + r`` with ``r``
orthogonal to ``s`` and of known length.  For a query ``q`` then

    <x, q> = gain * <s, q> + <r, q>,   |<r, q>| <= |r| * |q - its part along s|

by Cauchy-Schwarz.  ``<s, q>`` is a popcount of the code against ``PLANES``
bit planes of the turned query, whose rounding widens the interval by a known
amount.  So each row's score lies in a certain interval.  The rows of greatest
estimates, scored exactly, give a score that the result surely reaches; rows
whose interval cannot reach it are left out and the others scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.blocks import groups
from lexivec.llm.common import bounded_batches, in_slices, shuffle_parts
from lexivec.session import checkpointed

ROTATIONS = 8  # code bits per dimension
PLANES = 6  # bits of a query's turned component
SEED = 11
ANCHORS = 512  # of a block
ROWS = 8192  # of a block
POSITIVES = 5  # of an anchor
NEGATIVES = 3  # of a positive
LOW, HIGH, UNIT = 50, 95, 100  # UNIT * score between LOW and HIGH times the positive's score
LARGEST = 2.0**62  # greater components are cut to this


def rotation(width: int, rotations: int = ROTATIONS, seed: int = SEED) -> np.ndarray:
    """``(rotations * width, width)``: orthogonal matrices one below the other."""
    random = np.random.default_rng((seed, width))
    return np.concatenate([np.linalg.qr(random.standard_normal((width, width)))[0] for _ in range(rotations)])


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(code, gain, rest, size)`` of each row: the code's words of 64 bits,
    the factor of its code vector, the length of what that leaves, and the
    length of the code vector."""
    x = x.astype(np.float64)
    bits = x @ turn.T >= 0
    s = np.where(bits, 1.0, -1.0) @ turn
    size = np.linalg.norm(s, axis=1)
    gain = np.einsum("ij,ij->i", x, s) / np.maximum(size * size, 1e-300)
    rest = np.linalg.norm(x - gain[:, None] * s, axis=1)
    packed = np.packbits(bits, axis=1, bitorder="little")
    words = -(-packed.shape[1] // 8)
    packed = np.pad(packed, ((0, 0), (0, 8 * words - packed.shape[1])))
    return packed.view(np.uint64), gain, rest, size


def planes(q: np.ndarray, turn: np.ndarray, n_planes: int = PLANES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(planes, low, step, error)`` of each query's turned components as
    ``low + step * (0 .. 2**n_planes - 1)``: bit planes in 64-bit words, and
    the sum of all rounding errors."""
    v = q.astype(np.float64) @ turn.T
    low, top = v.min(axis=1), v.max(axis=1)
    step = np.maximum((top - low) / (2**n_planes - 1), 1e-300)
    level = np.clip(np.rint((v - low[:, None]) / step[:, None]), 0, 2**n_planes - 1)
    error = np.abs(v - low[:, None] - step[:, None] * level).sum(axis=1)
    level = level.astype(np.int64)
    words = -(-v.shape[1] // 64)
    out = np.zeros((n_planes, len(q), words), np.uint64)
    for b in range(n_planes):
        bits = np.packbits((level >> b & 1).astype(bool), axis=1, bitorder="little")
        out[b] = np.pad(bits, ((0, 0), (0, 8 * words - bits.shape[1]))).view(np.uint64)
    return out, low, step, error


def intervals(q: np.ndarray, code: np.ndarray, gain: np.ndarray, rest: np.ndarray, size: np.ndarray, turn: np.ndarray, n_planes: int = PLANES) -> tuple[np.ndarray, np.ndarray]:
    """``(low, high)`` of every score of a query (rows) with a coded vector
    (columns)."""
    bit, first, step, error = planes(q, turn, n_planes)
    # <s, q> = sum over the set bits of the turned query minus that over the others.
    total = np.zeros((len(q), len(code)))
    both = np.empty((len(q), len(code)), np.uint64)
    for b in range(n_planes):
        count = np.zeros((len(q), len(code)), np.uint16)
        for w in range(code.shape[1]):
            np.bitwise_and(bit[b][:, w, None], code[None, :, w], out=both)
            count += np.bitwise_count(both)
        total += count * np.float64(2**b)
    ones = np.bitwise_count(code).sum(axis=1)
    levels = sum(np.bitwise_count(bit[b]).sum(axis=1) * np.float64(2**b) for b in range(n_planes))
    n = turn.shape[0]
    dot = 2 * (first[:, None] * ones + step[:, None] * total) - (first * n + step * levels)[:, None]
    length = np.linalg.norm(q.astype(np.float64), axis=1)
    along = np.maximum(np.abs(dot) - error[:, None], 0) / np.maximum(size, 1e-300)
    across = np.sqrt(np.maximum(length[:, None] ** 2 - along**2, 0))
    # Far above what double precision loses in either term.
    reach = np.abs(gain) * error[:, None] + rest * across + 1e-9 * (length[:, None] * (np.abs(gain) * size + rest)) + 0.5
    return gain * dot - reach, gain * dot + reach


def scored(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer arrays, pair by pair;
    those beyond long are cut to it."""
    if not q.shape[1] or not len(q):
        return np.zeros(len(q), np.int64)
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * q.shape[1]
    if most < 2**52:
        return np.einsum("ij,ij->i", q.astype(np.float64), x.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return np.einsum("ij,ij->i", q, x)
    return np.array([max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(i, j)))) for i, j in zip(q.tolist(), x.tolist())], np.int64)


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the first ``n`` of each owner by falling score, then id."""
    order = np.lexsort((ids, -score.astype(np.float64), owner)) if not len(score) or np.abs(score).max() < 2**52 else np.array(
        sorted(range(len(owner)), key=lambda k: (owner[k], -int(score[k]), ids[k])), np.int64)
    own = owner[order]
    new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    place = np.arange(len(own)) - np.repeat(new, np.diff(np.r_[new, len(own)]))
    return order[place < n]


def _nth_largest(a: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row, -inf where there are fewer."""
    return np.partition(a, -n, axis=1)[:, -n] if a.shape[1] >= n else np.full(len(a), -np.inf)


def _pairs(wanted: np.ndarray, q: np.ndarray, x: np.ndarray, at_once: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, score)`` of the wanted pairs, scored in slices."""
    i, j = np.nonzero(wanted)
    scores = [scored(q[i[k : k + at_once]], x[j[k : k + at_once]]) for k in range(0, len(i), at_once)]
    return i, j, np.concatenate(scores) if scores else np.empty(0, np.int64)


def _reached(middle: np.ndarray, bottom: np.ndarray, top: np.ndarray, q: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Of each query a score that ``n`` rows surely reach between ``bottom``
    and ``top``: the n-th exact one of the rows of greatest estimates, -inf
    where fewer of those lie there.  ``middle`` is -inf for rows left out."""
    m = min(2 * n, middle.shape[1])
    j = np.argpartition(middle, -m, axis=1)[:, -m:]
    i = np.repeat(np.arange(len(middle)), m)
    score = scored(q[i], x[j.ravel()]).reshape(len(middle), m)
    inside = np.isfinite(np.take_along_axis(middle, j, 1)) & (score >= bottom[:, None]) & (score <= top[:, None])
    return _nth_largest(np.where(inside, score, -np.inf), n)


def nearest(low: np.ndarray, high: np.ndarray, allowed: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, row, score)`` of the first ``n`` allowed rows of each query."""
    all_ = np.full(len(q), np.inf)
    sure = _reached(np.where(allowed, (low + high) / 2, -np.inf), -all_, all_, q, x, n)
    i, j, score = _pairs(allowed & (high >= sure[:, None]), q, x)
    keep = _best(i, score, ids[j], n)
    return i[keep], j[keep], score[keep]


def within(low: np.ndarray, high: np.ndarray, allowed: np.ndarray, bottom: np.ndarray, top: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(query, window, row, score)`` of the first ``n`` allowed rows whose
    score lies in each of a query's windows ``bottom .. top``."""
    wanted = np.zeros(low.shape, bool)
    middle = (low + high) / 2
    for w in range(bottom.shape[1]):
        b, t = bottom[:, w], top[:, w]
        sure = _reached(np.where(allowed & (middle <= t[:, None]), middle, -np.inf), b, t, q, x, n)
        wanted |= allowed & (high >= np.maximum(b, sure)[:, None]) & (low <= t[:, None])
    i, j, score = _pairs(wanted, q, x)
    out = []
    for w in range(bottom.shape[1]):
        inside = np.flatnonzero((score >= bottom[i, w]) & (score <= top[i, w]))
        keep = inside[_best(i[inside], score[inside], ids[j[inside]], n)]
        out.append((i[keep], np.full(len(keep), w), j[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def coded(vectors: DataFrame, rotations: int = ROTATIONS) -> DataFrame:
    """``key, vec_id, label, width, vec, code, gain, rest, size``: one row per
    vec_id, label and integer vector; ``key`` is the digest of the three."""
    out = pa.schema([("key", pa.binary()), ("vec_id", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("vec", pa.binary()), ("code", pa.binary()),
                     ("gain", pa.float64()), ("rest", pa.float64()), ("size", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in in_slices(batches, 1000):
            ids, labels = (b.column(k).to_numpy() for k in (0, 1))
            lists = b.column(2)
            widths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            ends = np.cumsum(widths)
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                x = flat[(ends[own] - width)[:, None] + np.arange(width)]
                x = np.clip(np.floor(x * 256.0), -LARGEST, LARGEST).astype(np.int64)
                if width not in turns:
                    turns = {width: rotation(width, rotations)}  # the last width's alone
                code, gain, rest, size = encode(x, turns[width])
                names = np.stack([ids[own], labels[own]], axis=1).astype(np.int64)
                keys = [xxhash.xxh3_128_digest(n.tobytes() + v.tobytes()) for n, v in zip(names, x)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.binary()), pa.array(ids[own]), pa.array(names[:, 1]), pa.array(np.full(len(own), width, np.int32)), pa.array([_short(v) for v in x], pa.binary()),
                    pa.array([c.tobytes() for c in code], pa.binary()), pa.array(gain), pa.array(rest), pa.array(size)], schema=out)

    bounded_batches(vectors.sparkSession)
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    slim = slim.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    slim = slim.where(~F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    rows = slim.mapInArrow(run, "key binary, vec_id long, label long, width int, vec binary, code binary, gain double, rest double, size double")
    return rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("vec_id", "label", "width", "vec", "code", "gain", "rest", "size")])


def _short(v: np.ndarray) -> bytes:
    """The vector's bytes, in 16 bits a component where they hold it."""
    short = v.astype(np.int16)
    return (short if (short == v).all() else v).tobytes()


def _integers(raw: list[bytes], width: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.int16 if len(r) == 2 * width else np.int64).astype(np.int64) for r in raw])


def in_block_pairs(anchors: DataFrame, rows: DataFrame, by: list[str], n_anchors: int = ANCHORS, n_rows: int = ROWS) -> DataFrame:
    """Anchors and rows that agree in ``by``, each cut into numbered blocks of
    bounded size, dealt to every pair of an anchors' and a rows' block:
    partitioned and sorted by ``by, _i, _j``, with ``_side`` 0 for anchors.
    A hot ``by`` only has more blocks, so its work spreads over all tasks."""
    def counted(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias(name))

    sizes = checkpointed(counted(anchors, n_anchors, "_n").join(counted(rows, n_rows, "_m"), by))

    def dealt(df: DataFrame, side: int, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        out = df.join(sizes, by).withColumn(own, F.pmod(F.xxhash64("key"), F.col(mine)))
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1)))
        return out.drop("_n", "_m").withColumn("_side", F.lit(side))

    both = dealt(anchors, 0, "_i", "_j", "_n", "_m").unionByName(dealt(rows, 1, "_j", "_i", "_m", "_n"), allowMissingColumns=True)
    order = [*by, "_i", "_j"]
    return both.repartition(shuffle_parts(rows), *order).sortWithinPartitions(*order, "_side")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], turns: dict[int, np.ndarray], rotations: int) -> Iterator[tuple]:
    """``(anchors, rows, integers of both, intervals)`` of each pair of blocks."""
    for t, group in groups(batches, [*by, "_i", "_j"], 4000):
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        sides = t.column("_side").to_numpy()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            n = int((sides[lo:hi] == 0).sum())
            if not 0 < n < hi - lo:
                continue
            a, r = t.slice(lo, n), t.slice(lo + n, hi - lo - n)
            width = int(t.column("width")[lo].as_py())
            if width not in turns:
                turns.clear()
                turns[width] = rotation(width, rotations)
            q, x = _integers(a.column("vec").to_pylist(), width), _integers(r.column("vec").to_pylist(), width)
            code = np.stack([np.frombuffer(c, np.uint64) for c in r.column("code").to_pylist()])
            gain, rest, size = (r.column(c).to_numpy() for c in ("gain", "rest", "size"))
            for k in range(0, n, 64):  # so many at once, whatever a block holds
                yield a.slice(k, 64), r, q[k : k + 64], x, *intervals(q[k : k + 64], code, gain, rest, size, turns[width])


def positives(anchors: DataFrame, rows: DataFrame, n: int = POSITIVES, rotations: int = ROTATIONS, n_anchors: int = ANCHORS, n_rows: int = ROWS) -> DataFrame:
    """``anchor, positive_id, positive_score, place``: of each anchor its
    first ``n`` other rows of its label; ``anchor`` is its key."""
    out = pa.schema([("anchor", pa.binary()), ("row", pa.binary()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    by = ["label", "width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, r, q, x, low, high in _groups(batches, by, {}, rotations):
            ids, keys = r.column("vec_id").to_numpy(), r.column("key").to_pylist()
            i, j, score = nearest(low, high, a.column("vec_id").to_numpy()[:, None] != ids, q, x, ids, n)
            yield pa.RecordBatch.from_arrays([a.column("key").take(i).combine_chunks(), pa.array([keys[k] for k in j], pa.binary()), pa.array(ids[j]), pa.array(score)], schema=out)

    found = in_block_pairs(anchors.select("key", "vec_id", "label", "width", "vec"), rows, by, n_anchors, n_rows).mapInArrow(run, "anchor binary, row binary, positive_id long, positive_score long")
    return _first(found, ["anchor"], [F.desc("positive_score"), F.asc("positive_id"), F.asc("row")], n, "place").drop("row")


def _first(df: DataFrame, by: list[str], order: list[Column], n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         rotations: int = ROTATIONS, n_anchors: int = ANCHORS, n_rows: int = ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for each anchor and each of its positives.

    ``vectors(vec_id, label, embedding)``: components become ``floor(256 *
    c)``, a score is an integer inner product, and higher scores come first,
    ties by smaller vec_id.  An anchor's positives are its first
    ``n_positives`` other rows of its label; a positive's negatives the first
    ``n_negatives`` rows of other labels with ``low * positive_score <= 100 *
    negative_score <= high * positive_score``.  Fewer, if there are fewer.

    Rows with a null vec_id or label, and vectors that are null, empty or hold
    a null or non-finite component take no part.  Only vectors of one width
    meet.  Rows that agree in vec_id, label and vector count once; rows that
    share the anchor's vec_id are not its positives.  Components beyond 2**62
    are cut to it and scores beyond long to long.  Other columns are not read.
    """
    rows = checkpointed(coded(vectors, rotations))
    anchors = rows.where(is_anchor)
    chosen = checkpointed(positives(anchors, rows, n_positives, rotations, n_anchors, n_rows))
    # 100 * n >= low * p and 100 * n <= high * p for integers n; decimals don't overflow.
    p = F.col("positive_score").cast("decimal(25,0)")
    window = F.struct("place", F.ceil(p * low / F.lit(UNIT).cast("decimal(3,0)")).cast("long").alias("bottom"), F.floor(p * high / F.lit(UNIT).cast("decimal(3,0)")).cast("long").alias("top"))
    windows = chosen.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("windows"))  # at most n_positives each
    asked = anchors.select("key", "vec_id", "label", "width", "vec").join(windows, F.col("key") == F.col("anchor")).drop("anchor")
    out = pa.schema([("anchor", pa.binary()), ("place", pa.int32()), ("row", pa.binary()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, r, q, x, at_least, at_most in _groups(batches, ["width"], {}, rotations):
            ids, keys = r.column("vec_id").to_numpy(), r.column("key").to_pylist()
            given = a.column("windows").to_pylist()
            n = max(len(g) for g in given)
            bottom, top = (np.array([[w[c] for w in g] + [empty] * (n - len(g)) for g in given], np.int64) for c, empty in (("bottom", 2**62), ("top", -(2**62))))
            other = a.column("label").to_numpy()[:, None] != r.column("label").to_numpy()
            i, w, j, score = within(at_least, at_most, other, bottom, top, q, x, ids, n_negatives)
            place = np.array([given[k][m]["place"] for k, m in zip(i, w)], np.int32)
            yield pa.RecordBatch.from_arrays([a.column("key").take(i).combine_chunks(), pa.array(place), pa.array([keys[k] for k in j], pa.binary()), pa.array(ids[j]), pa.array(score)], schema=out)

    met = in_block_pairs(asked, rows, ["width"], n_anchors, n_rows).mapInArrow(run, "anchor binary, place int, row binary, negative_id long, negative_score long")
    best = _first(met, ["anchor", "place"], [F.desc("negative_score"), F.asc("negative_id"), F.asc("row")], n_negatives, "rank")
    named = chosen.join(anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(best, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
