import re
from collections import Counter, defaultdict

import pytest
from conftest import DOCS, ODD, SF01, doc
from lexivec.llm import mixing
from pyspark.sql import functions as F


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes):
    """Targets by resharing round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        to = {s: 3.0 * sizes[s] if s in full else rest / open_ * weight[s] for s in order} if open_ else {s: 3.0 * sizes[s] for s in order}
        over = {s for s in order if to[s] > 3 * sizes[s]}
        if not over:
            return to
        full |= over


def check(docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    to = shares(sizes)
    got = mixing.taken(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    sums = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(to[r["source"]])
        sums[r["source"]] += r["taken"]
    return sums, to


def test_whole_table_is_near_its_targets(spark):
    import pandas as pd
    rows = [tuple(r) for r in pd.read_parquet(f"{SF01}/documents.parquet")[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False)]
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    sums, to = check(docs, rows)
    assert all(abs(sums[s] - t) <= 0.03 * t for s, t in to.items())
    assert sorted(map(tuple, mixing.taken(docs.repartition(5)).collect())) == sorted(map(tuple, mixing.taken(docs).collect()))


def test_small_sources_are_repeated_and_hot_ones_cut(spark):
    rows = [doc(i, "w " * 30, "hot") for i in range(300)] + [doc(1000, "tiny one here", "a"), doc(1001, "x y z " * 40, "b"), doc(1002, "m " * 100, None)]
    sums, to = check(spark.createDataFrame(rows, DOCS), rows)
    assert sums["a"] == 9 and sums["b"] == 360 and to["a"] == 9
    assert abs(sum(sums.values()) - sum(map(lambda r: size(r[1]), rows))) < 0.02 * sum(sums.values())


def test_odd_rows(odd, empty, spark):
    sums, to = check(odd, ODD)
    assert all(abs(sums[s] - to[s]) < 0.02 * to[s] + 3 for s in to)
    assert mixing.taken(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([doc(1, None), doc(2, " ")], DOCS)
    assert [r["taken"] for r in mixing.taken(blank).collect()] == [0, 0]


def test_many_sources_meet_their_targets(spark):
    rows = [doc(i, "w " * (1 + i % 7), f"s{i % 1500}") for i in range(6000)]
    sums, to = check(spark.createDataFrame(rows, DOCS), rows)
    assert abs(sum(sums.values()) - sum(to.values())) < 0.1 * sum(to.values())


def test_a_long_tail_of_tiny_sources_meets_each_target(spark):
    tail = [1, 2, 5, 10, 12, 21, 40, 64, 150, 600, 1300]
    rows = [doc(i, "w " * tail[i % len(tail)], f"s{i:04}") for i in range(330)]
    rows += [doc(1000 + i, "w " * 1000, f"t{i % 3}") for i in range(400)]
    assert mixing.block_words(sum(size(r[1]) for r in rows)) == mixing.BLOCK
    sums, to = check(spark.createDataFrame(rows, DOCS), rows)
    small = [s for s in to if s[0] == "s"]
    assert all(to[s] < mixing.SETTLED * mixing.BLOCK and abs(sums[s] - to[s]) <= 0.5 for s in small) and len(small) == 330
    assert all(abs(sums[s] - t) <= 0.03 * t for s, t in to.items())


def test_slots_are_low_discrepancy(spark):
    docs = spark.createDataFrame([doc(i, "w " * 50, "abc"[i % 3]) for i in range(600)], DOCS)
    _, to = mixing.placed(docs)
    slots, _ = mixing.schedule(to)
    rows = slots.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    seen = Counter()
    for k, r in enumerate(rows, 1):
        assert r["rank"] == seen[r["source_no"]]
        seen[r["source_no"]] += 1
        assert all(abs(seen[s] - k * (s + 1) / 6) < 6 for s in range(3))


def test_mixed_documents_hold_what_is_taken(spark, odd):
    for docs in (spark.read.parquet(f"{SF01}/documents.parquet"), odd):
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
        once = mixing.taken(docs).groupBy("doc_id", "source").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
        want = {(r["doc_id"], r["source"]): (r["taken"], r["rows"]) for r in once.collect()}
        have = Counter()
        for r in mixed.collect():
            have[r["doc_id"], r["source"]] += size(r["text"])
            assert r["n_chars"] == len(r["text"])
        assert all(n - rows < have[k] <= n for k, (n, rows) in want.items())
