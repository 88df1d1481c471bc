"""Splits, samples, class lists and feature numbers without a sort of whole rows."""

import hashlib
import random

from pyspark.sql import functions as F

from lexivec.operators import corpus as C
from lexivec.operators import dictionary as D
from lexivec.operators import lexicon as L
from lexivec.operators import ordering
from lexivec.sources import sinks


def _by_hash(keys):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}42".encode()).hexdigest(), k))


def test_holdout_split_is_exact_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FEW_ROWS", 2)  # more passes over the digits
    monkeypatch.setattr(ordering, "HEX_DIGITS", 1)
    df = spark.range(500).withColumn("split_text", F.lit("x"))
    order = _by_hash(range(500))
    for n, first in ((0, 0), (1, 1), (137, 137), (499, 499), (500, 500), (9000, 500), (0.25, 125)):
        # 1 is the ratio of all rows, as before
        want = set(order[: 500 if n == 1 else first])
        got = {r.id for r in C.holdout_split(df, "id", n).where("split = 'valid'").collect()}
        assert got == want


def test_holdout_split_moves_no_rows(spark):
    plan = C.holdout_split(spark.range(500), "id", 100)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_holdout_split_of_null_and_repeated_keys(spark):
    rows = [(None,), (None,)] + [(f"k{i % 20}",) for i in range(60)]
    df = spark.createDataFrame(rows, "key string")
    got = C.holdout_split(df, "key", 10)
    sides = {}
    for r in got.collect():
        sides.setdefault(r.key, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values()) and sides[None] == {"valid"}
    assert got.where("split = 'valid'").count() == 11  # two without a key, three whole keys
    assert C.holdout_split(df.limit(0), "key", 10).count() == 0
    only = C.holdout_split(df.where("key IS NULL"), "key", 1.0)
    assert [r.split for r in only.collect()] == ["valid", "valid"]


def test_class_sample_against_brute_force(spark):
    rows = [("a" if i % 3 else None, i, "text") for i in range(300)] + [("b", i, "text") for i in range(4)]
    df = spark.createDataFrame(rows, "cls string, key int, text string").repartition(5)
    got = {(r.cls, r.key) for r in C.class_sample(df, "cls", "key", 7).collect()}
    want = {(c, k) for c in ("a", "b", None) for k in _by_hash([r[1] for r in rows if r[0] == c])[:7]}
    assert got == want


def test_class_lists_in_pieces(spark, tmp_path):
    lex = spark.createDataFrame([(f"t{i:03d}", "big") for i in range(25)] + [("x", "small"), (None, "small")], "term string, cls string")
    pieces = L.invert(lex.repartition(3), size=10)
    got = {(r.cls, r.piece): list(r.terms) for r in pieces.collect()}
    assert {k: len(v) for k, v in got.items()} == {("big", 0): 10, ("big", 1): 10, ("big", 2): 5, ("small", 0): 1}
    assert got["big", 0] + got["big", 1] + got["big", 2] == [f"t{i:03d}" for i in range(25)]
    sinks.write_class_lists(pieces, str(tmp_path / "lists"))
    lines = [line for f in sorted((tmp_path / "lists").glob("part-*")) for line in f.read_text().splitlines()]
    assert [line.split("\t")[:2] for line in lines] == [["big", "0"], ["big", "1"], ["big", "2"], ["small", "0"]]


def test_features_numbered_in_one_exchange(spark, request):
    """A name held by most documents is cut by partitions; numbers and
    magnitudes equal those of fit and transform."""
    rnd = random.Random(3)
    rows = [(i, 0, "words", "the", rnd.choice([-1.0, 0.0, 1.0])) for i in range(3000)] + [(7000, 0, "words", "the", -9.0)]
    rows += [(i, rnd.randrange(2), "words", f"w{rnd.randrange(40)}", rnd.uniform(-2, 2)) for i in range(800)]
    rows += [(1, 1, "words", "zero", 0.0), (None, 1, "words", "w1", 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, block_no int, block string, name string, value double").repartition(6)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    names = D.fit(df)
    want = sorted(map(tuple, D.transform(df, names).collect()), key=str)
    entries, numbered = D.fit_transform(df)
    assert sorted(map(tuple, entries.collect()), key=str) == want
    cols = ["block_no", "name", "idx", "max_abs"]
    assert sorted(map(tuple, numbered.select(*cols).collect())) == sorted(map(tuple, names.select(*cols).collect()))
    spread = df.where("name = 'the'").sort("block_no", "name", F.abs("value").desc(), "doc_id").select(F.spark_partition_id()).distinct().count()
    assert spread > 1
    empty = D.fit_transform(df.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0
