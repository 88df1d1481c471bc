import math

import numpy as np
import pytest
from lexivec.llm import blocks, components
from lexivec.llm import near_vectors as nv
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=nv.LEAST_COSINE):
    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[i] = (x / np.linalg.norm(x), label)
    parent = {r[0]: r[0] for r in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    n = dict.fromkeys(parent, 0)
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= least:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (n[i], find(i)) for i in parent}


def clustered(n, seed, width=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    rows = []
    for i in range(n):
        c = rng.integers(0, 12)
        v = centres[c] + rng.standard_normal(width) * rng.choice([0.0, 0.2, 0.3, 2.0])
        rows.append((int(i * 7 % n), [float(x) for x in v.astype(np.float32)], int(c % 3)))
    return rows


@pytest.mark.parametrize("n, block", [(400, 512), (400, 16)])
def test_links_like_brute_force(spark, n, block):
    rows = clustered(n, 5)
    want = brute(rows)
    got = {r["vec_id"]: r for r in nv.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert len(got) == n
    found, there = sum(r["n_links"] for r in got.values()), sum(k for k, _ in want.values())
    assert there > 5000 and 0.97 * there <= found <= there
    assert all(r["n_links"] <= want[i][0] and r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert sum(r["component_id"] == want[i][1] for i, r in got.items()) >= 0.98 * n


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one, 0), (2, one, 0), (3, [2.0, 0.0, 0.0], 0), (4, one, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [math.nan, 1.0, 0.0], 0), (8, [math.inf, 1.0, 0.0], 0),
            (9, [None, 1.0, 0.0], 0), (10, [], 0), (11, [1.0, 0.0], 0), (12, one, 1), (13, [1.0], 0), (14, [3.0], 0), (15, [1e30, 1e30, 0.0], 0), (16, [1e-30, 1e-30, 0.0], 0)]
    docs = spark.createDataFrame(rows + [(None, one, 0)], SCHEMA).withColumn("n", F.lit("x")).withColumn("digest", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nv.near_duplicates(docs).collect()}
    assert got.pop(None) == (0, None)
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), **{i: (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)}, 13: (1, 13), 14: (1, 13), 15: (1, 15), 16: (1, 15)}
    assert nv.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in nv.near_duplicates(spark.createDataFrame([(1, one, 0), (1, one, 0)], SCHEMA)).collect()] == [(1, 1, 1, True)] * 2


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(nv.hadamard(nv.hadamard(x)), 16 * x)


def test_block_pairs_meet_each_pair_once(spark):
    rows = [(k % 3, i) for i in range(300) for k in [0 if i < 200 else i]] + [(99, 1)]
    dealt = blocks.block_pairs(spark.createDataFrame(rows, "key long, id long"), "key", "id", 16).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r["key"], r["_i"], r["_j"]), []).append((r["id"], r["_block"]))
    seen = set()
    for (key, i, j), members in groups.items():
        a, b = ([m for m, own in members if own == side] for side in (i, j))
        assert len(a) < 60 and len(b) < 60
        pairs = {(min(x, y), max(x, y)) for x in a for y in b if x != y}
        assert not {(key, *p) for p in pairs} & seen
        seen |= {(key, *p) for p in pairs}
    want = {(k, x, y) for k, x in rows for q, y in rows if k == q and x < y}
    assert seen == want


def test_components_of_chains_stars_and_loose_nodes(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(5000, 5000)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (150, 2))]
    nodes = sorted({x for e in edges for x in e} | {9000})
    parent = {x: x for x in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    values = spark.createDataFrame([(x, -x if x != 9000 else None) for x in nodes], "node long, value long")
    got = {r["node"]: r["least"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), values).collect()}
    least = {}
    for x in nodes:
        least[find(x)] = min(least.get(find(x), 0), -x)
    assert got == {x: least[find(x)] if x != 9000 else None for x in nodes}
