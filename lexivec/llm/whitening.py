"""Whitening of embeddings by spectrum slicing.

Vectors become integer vectors ``x``; the fit list holds each distinct one
once.  Its covariance is gathered by Spark in two passes (sums, then centred
products).  The leading eigenpairs of that ``width x width`` matrix come from
the inertia of ``V - s I = L D L^T``: the number of positive pivots is the
number of eigenvalues above ``s``, so bisection isolates the k-th one, Rayleigh
quotient iteration converges cubically inside its slice, and two more counts
certify that the pair found is the k-th.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import bounded_batches, in_slices
from lexivec.session import checkpointed

COMPONENTS = 4
MOST_WIDTH = 4096  # dimensions: the covariance alone passes the driver
RANK_FLOOR = 1e-12  # of the trace; components below it have no variance to scale
_ALPHA = (1 + 17**0.5) / 8


def inertia(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix: of the positive
    pivots of its LDL^T factors, with symmetric pivoting by 1x1 and 2x2 blocks
    (Bunch and Kaufman), so that no growth spoils the signs."""
    a = a.copy()
    n, k, positive = len(a), 0, 0
    while k < n:
        rest = np.abs(a[k + 1 :, k])
        most = rest.max() if len(rest) else 0.0
        size, pivot = 1, k
        if max(abs(a[k, k]), most) == 0:
            k += 1
            continue
        if abs(a[k, k]) < _ALPHA * most:
            r = k + 1 + int(rest.argmax())
            column = np.abs(a[k:, r])
            column[r - k] = 0
            other = column.max()
            if abs(a[k, k]) * other >= _ALPHA * most * most:
                pass
            elif abs(a[r, r]) >= _ALPHA * other:
                pivot = r
            else:
                size, pivot = 2, r
        at = k + size - 1
        if pivot != at:
            a[[at, pivot], k:] = a[[pivot, at], k:]
            a[k:, [at, pivot]] = a[k:, [pivot, at]]
        below = a[k + size :, k : k + size]
        if size == 1:
            positive += a[k, k] > 0
            a[k + 1 :, k + 1 :] -= below @ (below.T / a[k, k])
        else:
            block = a[k : k + 2, k : k + 2]
            positive += 1  # a 2x2 pivot has one eigenvalue of each sign
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(block, below.T)
        k += size
    return int(positive)


def above(v: np.ndarray, s: float) -> int:
    """Number of eigenvalues of ``v`` above ``s``."""
    return inertia(v - s * np.eye(len(v)))


class Pair(NamedTuple):
    value: float
    vector: np.ndarray
    certified: bool  # counts on either side of the value number it


def _refined(v: np.ndarray, value: float, start: np.ndarray, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Inverse iteration at ``value``, then Rayleigh quotient iteration, apart
    from the vectors found."""
    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for f in found:
                x = x - (f @ x) * f
        return x / np.linalg.norm(x)

    scale = max(np.abs(v).max(), 1e-300)
    x, theta = apart(start), value
    best = np.inf, float(x @ v @ x), x
    for step in range(12):
        shifted = v - theta * np.eye(len(v))
        try:
            y = np.linalg.solve(shifted, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(shifted + scale * 2.0**-50 * np.eye(len(v)), x)
        if not np.isfinite(y).all() or not y.any():
            break
        x = apart(y / np.abs(y).max())
        quotient = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - quotient * x))
        if residual < best[0]:
            best = residual, quotient, x
        elif step > 2:
            break
        if step >= 1:  # the first two steps stay at the slice's middle
            theta = quotient
    return best[1], best[2]


def leading(v: np.ndarray, n: int = COMPONENTS) -> list[Pair]:
    """The ``n`` leading eigenpairs of a symmetric matrix by falling value.

    An eigenvalue that the counts cannot part from its neighbours at double
    precision is one of a multiple: any orthonormal vectors of its space do.
    """
    width = len(v)
    n = min(n, width)
    radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
    bottom, top = float((np.diag(v) - radius).min()), float((np.diag(v) + radius).max())
    scale = max(abs(bottom), abs(top), 1e-300)
    bottom, top = bottom - 1e-9 * scale, top + 1e-9 * scale
    counts = {bottom: width, top: 0}  # shift -> eigenvalues above it
    random = np.random.default_rng(width)
    out: list[Pair] = []
    for k in range(1, n + 1):
        low = max(s for s, c in counts.items() if c >= k)
        high = min(s for s, c in counts.items() if c < k)
        # First a slice with the k-th eigenvalue alone, then one narrow against its distance from the others.
        more = 0
        while high - low > 4e-15 * scale and (counts[low] > k or counts[high] < k - 1 or more < 4):
            more += counts[low] == k and counts[high] == k - 1
            middle = (low + high) / 2
            counts[middle] = above(v, middle)
            low, high = (middle, high) if counts[middle] >= k else (low, middle)
        alone = counts[low] == k and counts[high] == k - 1
        value, vector = _refined(v, (low + high) / 2, random.standard_normal(width), [p.vector for p in out])
        while not low <= value <= high and alone and high - low > 4e-15 * scale:  # it ran to another one: start nearer
            for _ in range(6):
                middle = (low + high) / 2
                counts[middle] = above(v, middle)
                low, high = (middle, high) if counts[middle] >= k else (low, middle)
            value, vector = _refined(v, (low + high) / 2, vector, [p.vector for p in out])
        reach = 4 * float(np.linalg.norm(v @ vector - value * vector)) + 64 * width * 2.0**-52 * scale
        out.append(Pair(value, vector, above(v, value - reach) >= k and above(v, value + reach) <= k - 1))
    return out


class Fit(NamedTuple):
    n: int  # distinct vectors
    sums: np.ndarray  # long, of each dimension
    trace: float
    values: np.ndarray  # (components,)
    vectors: np.ndarray  # (components, width)


def integers(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """``vec_id, x`` (array of long) of the rows that take part: the vector is
    neither null nor empty, without null or non-finite components, and of the
    commonest width (the least of equals) if none is given."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    if width is None:
        sizes = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        first = sizes.orderBy(F.desc("n"), "w").first()
        width = first["w"] if first else 0
    if width > MOST_WIDTH:
        raise ValueError(f"vectors of {width} dimensions; at most {MOST_WIDTH}")
    return rows.where(F.size("v") == width).select("vec_id", F.transform("v", lambda c: F.floor(c * 256.0)).alias("x"))


def _matrix(b: pa.RecordBatch, column: int) -> np.ndarray:
    x = b.column(column)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and per-dimension sums, exact whatever their size: each task sends
    its own, high and low halves apart."""
    out = pa.schema([("n", pa.int64()), ("d", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b, 0)
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[n, np.zeros(len(high) - 1, np.int64)]), pa.array(np.arange(len(high), dtype=np.int32)), pa.array(high), pa.array(low)], schema=out)

    parts = fit.select("x").mapInArrow(run, "n long, d int, high long, low long").groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("d").collect()  # one row a dimension
    return sum(r["n"] for r in parts), [(r["high"] << 32) + r["low"] for r in parts]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the fit list, divisor ``n``.  Vectors are centred on the
    rounded mean before they are multiplied, so that integers stay exact and
    small; what rounding left is taken off afterwards."""
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    out = pa.schema([("i", pa.int32()), ("products", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                y = (_matrix(b, 0) - centre).astype(np.float64)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], schema=out)

    parts = fit.select("x").mapInArrow(run, "i int, products array<double>").select("i", F.posexplode("products").alias("j", "p"))
    rows = parts.groupBy("i", "j").agg(F.sum("p").alias("p")).groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "p"))), lambda s: s["p"]).alias("row")).orderBy("i").collect()  # width x width numbers
    left = np.array([float(s - n * int(c)) / n for s, c in zip(sums, centre)])
    v = np.array([r["row"] for r in rows]) / n - np.outer(left, left)
    return (v + v.T) / 2


def fitted(fit: DataFrame, n_components: int = COMPONENTS) -> Fit | None:
    """Sums and leading components of a fit list; None if it is empty.  Raises
    if the counts don't number a component as they should."""
    n, sums = _sums(fit)
    if not n:
        return None
    v = covariance(fit, n, sums)
    trace = float(np.trace(v))
    pairs = [p for p in leading(v, n_components) if p.value > RANK_FLOOR * trace] if trace > 0 else []
    if not all(p.certified for p in pairs):
        raise ArithmeticError("eigenvalues could not be numbered")
    return Fit(n, np.array(sums, object), trace, np.array([p.value for p in pairs]), np.array([p.vector for p in pairs]).reshape(len(pairs), len(v)))


def _centred(x: np.ndarray, f: Fit) -> np.ndarray:
    """``x - S / n`` in double precision: the quotient's whole part is taken
    off as an integer first."""
    whole = np.array([int(s) // f.n for s in f.sums], np.int64)
    part = np.array([(int(s) % f.n) / f.n for s in f.sums])
    return (x - whole) - part


def _whitened(x: np.ndarray, f: Fit) -> np.ndarray:
    return _centred(x, f) @ (f.vectors / np.sqrt(f.values)[:, None]).T


def _deviations(x: np.ndarray, f: Fit) -> list[int | None]:
    """Sum over dimensions of ``(n x - S)^2``, exact; None beyond long."""
    most = max(int(np.abs(x).max(initial=0)) * f.n, max(abs(int(s)) for s in f.sums))
    if 4 * most * most * x.shape[1] < 2**63:
        d = x * f.n - f.sums.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((f.n * a - int(s)) ** 2 for a, s in zip(row, f.sums)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def identity_error(fit: DataFrame, f: Fit) -> float:
    """Largest entry of the difference between the covariance of the fit
    list's whitened values and the identity."""
    k = len(f.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(_whitened(_matrix(b, 0), f).T)], names=[f"w{i}" for i in range(k)])

    values = fit.select("x").mapInArrow(run, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = values.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, got))


def whiten(vectors: DataFrame, n_components: int = COMPONENTS, width: int | None = None) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained,
    identity_error`` for each row that takes part and each component up to
    ``n_components``.

    Rows whose vector is null, empty, of another width than the commonest one,
    or holds a null or non-finite component are left out.  Repeated rows and
    null ids are rows like others; equal vectors count once in the fit.  There
    are as many components as the fit list has directions of variance (at most
    its width), so a single vector, or equal ones, give no rows; an empty table
    gives none.  ``deviation`` is null where it exceeds long.  Other columns
    are not read.
    """
    bounded_batches(vectors.sparkSession)
    rows = integers(vectors, width)
    fit = checkpointed(rows.select("x").distinct())
    f = fitted(fit, n_components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if f is None or not len(f.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k, error = len(f.values), identity_error(fit, f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 5000):
            x = _matrix(b, 1)
            m = len(x)
            ids = pa.chunked_array([b.column(0)]).take(np.repeat(np.arange(m), k)).combine_chunks()
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)), pa.array([d for d in _deviations(x, f) for _ in range(k)], pa.int64()),
                pa.array(_whitened(x, f).ravel()), pa.array(np.tile(f.values / f.trace, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
