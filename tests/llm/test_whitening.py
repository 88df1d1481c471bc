import numpy as np
import pytest
from conftest import SF01
from lexivec.llm import whitening
from lexivec.llm.queries import op13_whitening
from pyspark.sql import functions as F

VECS = "vec_id long, embedding array<double>, label int"


def brute(rows, n_components=4):
    """Rows by numpy's own eigenvectors: ``{(vec_id, component): (n, deviation, |whitened|, explained)}``."""
    x = np.floor(256 * np.array([v for _, v in rows]))
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [sum(map(int, c)) for c in fit.T]
    d = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(d.T @ d / n)
    out = {}
    for k in range(min(n_components, x.shape[1])):
        e, v = values[-1 - k], vectors[:, -1 - k]
        for (i, _), row in zip(rows, x):
            out[i, k + 1] = (n, sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)), abs((row - fit.mean(axis=0)) @ v) / np.sqrt(e), e / values.sum())
    return out


def agree(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - whitened) < 1e-7 and abs(r["explained"] - explained) <= 1e-9 * explained and r["identity_error"] < 1e-9


def with_spectrum(values, seed=0):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    v = (q * np.array(values, float)) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [
    [5, 5, 5, 1, 1, 0], [3, 3 - 1e-9, 2, 1, 1], [7, 7 * (1 - 1e-13), 3, 2] + [0] * 8, [2.0], [1e6] + [1] * 30, [1] * 9, [4, 3, 2, 1, -1, -2], [1e-9, 1e-10, 1e-11, 0], [1e12, 1e6, 1, 1e-6], list(range(40, 0, -1))])
def test_leading_pairs(values):
    v = with_spectrum(values)
    pairs = whitening.leading(v, 4)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    scale = np.abs(want).max()
    assert len(pairs) == min(4, len(values)) and all(p.certified for p in pairs)
    assert np.allclose([p.value for p in pairs], want, rtol=0, atol=1e-13 * scale)
    u = np.array([p.vector for p in pairs])
    assert np.abs(u @ u.T - np.eye(len(u))).max() < 1e-12
    assert all(np.linalg.norm(v @ p.vector - p.value * p.vector) < 1e-13 * scale for p in pairs)


def test_inertia_counts():
    random = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 25):
        for _ in range(20):
            a = random.integers(-2, 3, (n, n)).astype(float)
            a = a + a.T  # zeros on the diagonal need 2x2 pivots
            e = np.linalg.eigvalsh(a)
            for s in (-1.37, 0.11, 2.63):
                assert whitening.above(a, s) == (e > s).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1 and whitening.inertia(np.zeros((3, 3))) == 0


def test_whole_table(spark):
    import pandas as pd
    t = pd.read_parquet(f"{SF01}/embeddings.parquet")
    agree(op13_whitening(spark, SF01).collect(), brute([(int(i), [float(c) for c in v]) for i, v in zip(t.vec_id, t.embedding)]))


def test_repeats_count_once_and_far_means_keep_their_digits(spark):
    random = np.random.default_rng(2)
    v = random.standard_normal((80, 6)) * [4, 3, 2, 1, 0.5, 0.25] + 1e6
    rows = [(i, v[i % 80].tolist()) for i in range(200)] + [(1000 + i, v[0].tolist()) for i in range(100)]  # a third are copies of one
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], VECS)
    agree(whitening.whiten(df).collect(), brute(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    random = np.random.default_rng(5)
    good = [(i, random.standard_normal(3).tolist(), None) for i in range(12)]
    bad = [(90, None, 1), (91, [], 1), (92, [None, 1.0, 2.0], 1), (93, [nan, 1.0, 2.0], 1), (94, [1.0, -inf, 2.0], 1), (95, [1.0, 2.0], 1), (96, [1.0] * 4, 1)]
    df = spark.createDataFrame(good + bad + good[:2] + [(None, good[0][1], 3)], VECS)
    for name in ("x", "n", "component", "v", "row"):
        df = df.withColumn(name, F.lit("x"))
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * 15 and {r["n"] for r in got} == {12}
    agree([r for r in {(r["vec_id"], r["component"]): r for r in got if r["vec_id"] is not None}.values()], brute([(i, v) for i, v, _ in good]))
    by = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    assert all(by[None, k] == by[0, k] for k in (1, 2, 3))
    assert whitening.whiten(spark.createDataFrame([], VECS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1)] * 3, VECS)).collect() == []  # no variance
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 1) for i in range(5)], VECS)).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12  # one direction of variance
    huge = whitening.whiten(spark.createDataFrame([(i, [1e9 * i, 1e3 * i * i], 1) for i in range(5)], VECS)).collect()
    assert len(huge) == 10 and all(r["deviation"] is None for r in huge if r["vec_id"] != 2) and huge[0]["identity_error"] < 1e-6
