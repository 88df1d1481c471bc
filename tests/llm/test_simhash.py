import numpy as np
import pytest
import xxhash
from conftest import DOCS, ODD, SF01, doc
from lexivec.llm import simhash as sh


def plain(text):
    w = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """component of each (doc_id, text), by all pairs."""
    fps = [plain(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    u = np.array(fps, np.uint64)
    for k in range(len(rows)):
        for m in np.flatnonzero(np.bitwise_count(u ^ u[k]) <= sh.RADIUS):
            a, b = find(k), find(int(m))
            parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return fps, [least.get(find(k)) for k in range(len(rows))]


def test_tables_like_brute_force(spark):
    import pandas as pd
    rows = list(pd.read_parquet(f"{SF01}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None))
    rows = [(i, t[:2000]) for i, t in rows]
    fps, parts = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in sh.near_duplicates(docs).collect()}
    assert got == {i: (f, p) for (i, _), f, p in zip(rows, fps, parts)}
    assert sum(i != p for (i, _), p in zip(rows, parts)) > 20
    assert sorted(r["doc_id"] for r in sh.one_of_each(docs).collect()) == sorted(set(parts))


@pytest.mark.parametrize("block", [512, 8])
def test_planted_distances(spark, block):
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)]
    for base in fps[:60]:
        for d in (1, 3, 4, 5):
            fps.append(base ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    hub = fps[70]
    fps += [hub ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    u = np.unique(np.array(fps, np.uint64))
    parent = list(range(len(u)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k in range(len(u)):
        for m in np.flatnonzero(np.bitwise_count(u ^ u[k]) <= 4):
            a, b = find(k), find(int(m))
            parent[max(a, b)] = min(a, b)
    edges = sh.links(spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long"), block=block).collect()
    at = {int(x): k for k, x in enumerate(u.view(np.int64))}
    own = list(range(len(u)))

    def find2(a):
        while own[a] != a:
            a = own[a]
        return a

    for e in edges:
        a, b = find2(at[e["a"]]), find2(at[e["b"]])
        own[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(u))] == [find2(k) for k in range(len(u))]


def test_bk_forest_finds_all_within_radius():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**12, 300, dtype=np.uint64)
    fp = np.unique(fp)
    group = np.sort(rng.integers(0, 4, len(fp)))
    q, m = sh.BkForest(fp, group, 4).search(fp, group, 2)
    want = {(a, b) for a in range(len(fp)) for b in range(len(fp)) if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= 2}
    assert set(zip(q.tolist(), m.tolist())) == want and len(q) == len(want)


def test_odd_rows(odd, empty, spark):
    rows = [(r[0], r[1]) for r in ODD]
    fps, parts = brute(rows)
    key = lambda r: str(r)
    got = sorted([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in sh.near_duplicates(odd).collect()], key=key)
    assert got == sorted([(i, f, p) for (i, _), f, p in zip(rows, fps, parts)], key=key)
    kept = sh.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((p is None, p or 0) for p in set(parts))
    assert sh.near_duplicates(empty).count() == 0 and sh.one_of_each(empty).count() == 0
    nothing = spark.createDataFrame([doc(4, None), doc(2, " "), doc(None, "")], DOCS)
    assert {(r["fp"], r["component_id"]) for r in sh.near_duplicates(nothing).collect()} == {(0, 2)}
    with pytest.raises(ValueError):
        sh.links(spark.createDataFrame([(1,)], "fp long"), radius=6, parts=6)


def test_one_row_of_each_component_under_repeated_and_null_ids(spark):
    def near(k, n):
        """A text and one whose fingerprint differs by 1 to RADIUS bits."""
        text = " ".join(f"{k}{i}" for i in range(n))
        more = next(m for m in (f"{text} end{i}" for i in range(99)) if 0 < (plain(text) ^ plain(m)).bit_count() <= sh.RADIUS)
        return text, more

    (a, a2), (b, b2), (c, c2) = near("a", 600), near("b", 600), near("c", 600)
    rows = [doc(5, a), doc(5, b), doc(6, a2), doc(7, b2), doc(None, c), doc(None, c2), doc(None, c), doc(2**63 - 1, "an id as great as any")]
    df = spark.createDataFrame(rows, DOCS)
    kept = [(r["doc_id"], r["text"]) for r in sh.one_of_each(df).collect()]
    assert sorted(x for x in kept if x[0]) == [(5, a), (5, b), (2**63 - 1, rows[-1][1])]
    assert len(kept) == 4 and [t in (c, c2) for i, t in kept if i is None] == [True]
