import numpy as np
import pytest
from conftest import SF001
from lexivec.llm import hard_negatives as hn
from lexivec.llm.queries import op11_hard_negatives
from pyspark.sql import functions as F

VECS = "vec_id long, embedding array<double>, label int"
COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, n_pos=5, n_neg=3):
    """The contract's words as loops over Python integers."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = tuple(int(np.floor(256.0 * c)) for c in v)
        kept[i, label, x] = True
    out = []
    for i, label, q in kept:
        if not is_anchor(i):
            continue
        scores = [(sum(a * b for a, b in zip(q, x)), j, other) for j, other, x in kept if j != i and len(x) == len(q)]
        first = sorted((-s, j) for s, j, other in scores if other == label)[:n_pos]
        for p, j in first:
            near = sorted((-s, k) for s, k, other in scores if other != label and 50 * -p <= 100 * s <= 95 * -p)[:n_neg]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(near)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(COLS).collect())


@pytest.fixture(scope="module")
def vectors():
    random = np.random.default_rng(3)
    base = random.standard_normal((60, 12))
    v = base[random.integers(0, 60, 300)] + 0.5 * random.standard_normal((300, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[50:90] = v[49]  # a group of copies: ties
    label = np.where(np.arange(300) % 3 == 0, 7, np.arange(300) % 5)  # a hot label
    label[60:80] = 4
    return [(int(i), v[i].tolist(), int(label[i])) for i in range(300)]


def test_intervals_hold_every_score(vectors):
    x = np.floor(256 * np.array([v for _, v, _ in vectors])).astype(np.int64)
    turn = hn.rotation(12)
    low, high = hn.intervals(x[:40], *hn.encode(x, turn), turn)
    exact = x[:40] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.median(high - low) < 256 * 256  # far below the whole range of scores
    assert np.allclose(turn[:12] @ turn[:12].T, np.eye(12))
    gain, rest = hn.encode(x, turn)[1:3]
    assert (gain > 0).all() and (rest < 0.5 * np.linalg.norm(x, axis=1)).all()


def test_filter_leaves_rows_out_and_finds_the_same(vectors):
    random = np.random.default_rng(0)
    x = np.floor(256 * random.standard_normal((3000, 64)) / 8).astype(np.int64)
    turn = hn.rotation(64)
    low, high = hn.intervals(x[:20], *hn.encode(x, turn), turn)
    allowed = np.ones((20, 3000), bool)
    i, j, score = hn.nearest(low, high, allowed, x[:20], x, np.arange(3000), 5)
    exact = x[:20] @ x.T
    want = np.argsort(-exact, axis=1, kind="stable")[:, :5]
    assert sorted(zip(i, j)) == sorted((k, c) for k in range(20) for c in want[k])
    fifth = np.sort(exact, axis=1)[:, -5]
    assert (high >= fifth[:, None]).mean() < 0.3  # at best so many are scored


@pytest.mark.parametrize("blocks", [(512, 8192), (4, 16)])
def test_like_brute_force(spark, vectors, blocks):
    df = spark.createDataFrame(vectors, VECS)
    got = hn.mine(df, F.col("vec_id") % 10 == 0, n_anchors=blocks[0], n_rows=blocks[1])
    assert got.columns == COLS
    want = brute(vectors, lambda i: i % 10 == 0)
    assert rows_of(got) == want and len(want) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5, 0.0], 1), (0, [0.5, 0.5, 0.0], 1), (1, [0.5, 0.4, 0.0], 1), (2, [0.5, 0.4, 0.0], 1), (3, [0.3, 0.3, 0.1], 2), (4, [0.3, 0.3, 0.1], 2), (5, [0.3, 0.3, 0.1], 2), (6, [0.3, 0.3, 0.1], 2),
            (None, [0.4, 0.4, 0.1], 2), (7, None, 2), (8, [], 2), (9, [None, 0.1, 0.1], 2), (10, [nan, 0.3, 0.3], 2), (11, [inf, 0.1, 0.1], 2), (12, [0.3, 0.3, 0.3], None), (13, [0.3, 0.3], 2),
            (20, [0.0, 0.0, 0.0], 3), (21, [0.0, 0.0, 0.0], 3), (30, [-0.5, 0.0, 0.0], 4), (31, [0.1, 0.0, 0.0], 4), (40, [1e6, -1e6, 1.0], 5), (41, [1e6, -1e6, 2.0], 5), (42, [7e5, -7e5, 2.0], 6), (50, [9.0, 9.0], 7), (60, [1.0, 0.0, 0.0], 8)]
    df = spark.createDataFrame(rows, VECS)
    for name in ("key", "_side", "rank", "score", "anchor", "place", "code"):
        df = df.withColumn(name, F.lit("x"))
    got = rows_of(hn.mine(df, F.col("vec_id") % 10 == 0))
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert [g[1:4] for g in got if g[0] == 0] == [(1, 1, 3), (1, 2, 4), (1, 3, 5), (2, 1, 3), (2, 2, 4), (2, 3, 5)]
    assert hn.mine(spark.createDataFrame([], VECS), F.col("vec_id") % 10 == 0).collect() == []


def test_scores_beyond_doubles_are_exact(spark):
    big = float(2**40)
    rows = [(0, [big, 3.0], 1), (1, [big, 1.0], 1), (2, [big, 2.0], 1), (3, [big * 0.75, 5.0], 2), (4, [big * 0.75, 6.0], 2)]
    got = rows_of(hn.mine(spark.createDataFrame(rows, VECS), F.col("vec_id") == 0))
    cut = 2**63 - 1
    assert [(g[1], g[4]) for g in got] == []  # both scores are cut to long, above any window
    assert hn.scored(np.array([[2**30, 3]]), np.array([[2**30, 5]])).tolist() == [2**60 + 15]
    assert hn.scored(np.array([[2**48, 3]]), np.array([[2**48, 5]])).tolist() == [cut]


def test_whole_table(spark):
    import pandas as pd
    t = pd.read_parquet(f"{SF001}/embeddings.parquet")
    rows = [(int(i), [float(c) for c in v], int((n + 1) % 10 if i % 7 == 0 else n)) for i, v, n in zip(t.vec_id, t.embedding, t.label)]
    assert rows_of(op11_hard_negatives(spark, SF001)) == brute(rows, lambda i: i % 50 == 0)
