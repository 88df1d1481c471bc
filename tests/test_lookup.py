"""Token lookups: the broadcast and the join path agree; no shuffle of documents."""

import pytest
from pyspark.sql import functions as F

from lexivec.operators import corpus as C
from lexivec.operators import lexicon as L
from lexivec.operators.lookup import lookup_tokens

ROWS = [(1, ["a", "x", "b", "a"]), (2, []), (3, None), (4, ["x"]), (5, [None, "b"])]


@pytest.mark.parametrize("bound", [1_000_000, 1])
@pytest.mark.parametrize("keep", [False, True])
def test_both_paths(spark, bound, keep):
    docs = spark.createDataFrame(ROWS, "doc_id long, t array<string>").repartition(2)
    table = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, value string")
    out = lookup_tokens(docs, F.col("t"), table, fallback=F.col("t") if keep else None, max_keys=bound)
    x = "x" if keep else None
    assert {r.doc_id: r.found for r in out.collect()} == \
        {1: ["A", x, "B", "A"], 2: [], 3: [], 4: [x], 5: [None, "B"]}


def test_empty_table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, t array<string>")
    none = spark.createDataFrame([], "key string, value int")
    assert {r.doc_id: r.found for r in lookup_tokens(docs, F.col("t"), none).collect()}[1] == [None] * 4


def test_documents_are_not_shuffled(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.array(F.lit("a"), F.lit("x")).alias("t"))
    lex = spark.createDataFrame([("a", "P")], "term string, cls string")
    index = spark.createDataFrame([("a", 1)], "word string, idx int")
    for out in (L.project_lexicon(docs, F.col("t"), lex), C.to_ids(docs, F.col("t"), index, 10)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.projected for r in L.project_lexicon(docs, F.col("t"), lex).collect()} == {"P x"}
    assert {tuple(r.ids) for r in C.to_ids(docs, F.col("t"), index, 10).collect()} == {(1,)}


def test_projection_modes(spark):
    docs = spark.createDataFrame([(1, ["Good", "x"]), (2, None)], "doc_id long, t array<string>")
    lex = spark.createDataFrame([("good", "P")], "term string, cls string")
    one = lambda **k: {r.doc_id: r.projected for r in L.project_lexicon(docs, F.col("t"), lex, **k).collect()}
    assert one() == {1: "Good x", 2: ""}
    assert one(case_sensitive=False) == {1: "P x", 2: ""}
    assert one(case_sensitive=False, not_found="NONE") == {1: "P NONE", 2: ""}
