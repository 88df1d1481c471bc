"""Similarity joins copy no row for a pair of blocks and stay exact."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import similarity as M
from lexivec.operators import vectors as V


def _table(spark, n=90, dim=6):
    r = np.random.default_rng(3)
    m = r.integers(-2, 3, (n, dim)).astype(float)  # many ties
    m[1::3] += r.normal(0, 1e-9, (len(m[1::3]), dim))  # nearer than single precision tells apart
    return m, spark.createDataFrame([(f"w{i:02d}", v.tolist()) for i, v in enumerate(m)], "word string, vec array<double>").repartition(4)


def _cosines(m):
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(norm == 0, 1, norm)
    return u @ u.T


@pytest.mark.parametrize("rows, cols", [(8, 16), (1000, 1000)])
def test_top_k_is_exact(spark, rows, cols):
    m, df = _table(spark)
    c = _cosines(m)
    np.fill_diagonal(c, -np.inf)
    got = {}
    for r in V.knn(df, df, 7, row_block=rows, query_block=cols).collect():
        got.setdefault(int(r.query[1:]), {})[r["rank"]] = (int(r.word[1:]), r.sim)
    assert len(got) == len(m)
    for q, found in got.items():
        assert sorted(found) == list(range(1, 8))
        best = np.sort(c[q])[::-1][:7]
        for rank, (w, sim) in found.items():
            assert abs(sim - c[q, w]) < 1e-12 and abs(sim - best[rank - 1]) < 1e-12


def test_no_row_is_copied_through_an_exchange(spark):
    _, df = _table(spark)
    for found in (V.knn(df, df, 3, row_block=8, query_block=16), V.closest_class_scores(df, df.select(F.col("word").alias("term"), F.substring("word", 2, 1).alias("cls")), row_block=8, query_block=16)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan


def test_class_maxima_of_many_classes(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_CLASSES", 4)
    m, df = _table(spark)
    lex = df.select(F.col("word").alias("term"), (F.substring("word", 2, 2).cast("int") % 30).cast("string").alias("cls"))
    c = _cosines(m)
    got = {(r.word, r.cls): r.score for r in V.closest_class_scores(df, lex, row_block=16, query_block=16).collect()}
    assert len(got) == 90 * 30
    assert all(abs(s - c[int(w[1:]), np.arange(90) % 30 == int(k)].max()) < 1e-12 for (w, k), s in got.items())
