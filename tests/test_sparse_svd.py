"""M9 on sparse rows against numpy's SVD of the same matrix."""

import numpy as np
import pytest

from lexivec.operators import sparse_svd as S


def _rows(x, extra=()):
    return [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]], "clash") for i, r in enumerate(x)] + list(extra)


@pytest.fixture(scope="module")
def x():
    rnd = np.random.default_rng(2)
    strong = rnd.normal(size=(300, 5)) * [30, 20, 12, 8, 5] @ rnd.normal(size=(5, 80))
    return np.where(rnd.random((300, 80)) < 0.3, strong + rnd.normal(size=(300, 80)), 0.0) * (np.arange(80) % 11 > 0)


SHAPE = "doc_id long, indices array<int>, values array<double>, y string"


def test_strongest_components(spark, x, monkeypatch):
    monkeypatch.setattr(S, "ENTRIES", 500)
    monkeypatch.setattr(S, "HELD_COLUMNS", 30)
    rows = spark.createDataFrame(_rows(x, [(900, None, None, ""), (901, [], [], ""), (902, [3, 4], [None, 2.0], "")]), SHAPE).repartition(5)
    full = np.vstack([x, np.zeros((2, 80)), np.eye(80)[4:5] * 2])
    want = np.linalg.svd(full, compute_uv=False)
    for bound in (1000, 3):  # columns come to the rows, or are joined to their entries
        model = S.fit(rows, k=6, oversample=15, iterations=8, max_columns=bound)
        assert model.singular == pytest.approx(want[:6], rel=1e-3)
        got = {r.doc_id: r.components for r in model.transform(rows, max_columns=bound).collect()}
        us = np.array([got[i] for i in [*range(300), 900, 901, 902]])
        assert us.T @ us == pytest.approx(np.diag(want[:6] ** 2), rel=1e-3, abs=1e-3 * want[0] ** 2)
        assert got[900] == got[901] == [0.0] * 6


def test_full_rank_keeps_all_products(spark, x):
    small = x[:40, :12]
    rows = spark.createDataFrame(_rows(small), SHAPE).repartition(3)
    model = S.fit(rows, k=20)
    assert len(model.singular) == np.linalg.matrix_rank(small)
    got = {r.doc_id: r.components for r in model.transform(rows).collect()}
    us = np.array([got[i] for i in range(40)])
    assert us @ us.T == pytest.approx(small @ small.T, abs=1e-6)
    new = spark.createDataFrame([(1, [2, 500], [1.0, 7.0], "")], SHAPE)  # column 500 is unknown
    vec = np.array(model.transform(new).first().components)
    assert vec @ vec == pytest.approx(1.0, abs=1e-6)


def test_nothing_to_fit(spark):
    for rows in ([], [(1, [], [], ""), (2, None, None, "")], [(1, [4], [0.0], "")]):
        df = spark.createDataFrame(rows, SHAPE)
        model = S.fit(df, k=3)
        assert len(model.singular) == 0
        assert [r.components for r in model.transform(df).collect()] == [[]] * len(rows)


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, [0, 1], [3.0, 4.0], "")] * 5, SHAPE)
    model = S.fit(df, k=3)
    assert model.singular == pytest.approx([5 * 5**0.5])
    assert [abs(r.components[0]) for r in model.transform(df).collect()] == pytest.approx([5.0] * 5)
