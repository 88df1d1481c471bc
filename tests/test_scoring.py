"""The score kernels against their joins, and class repulsion against plain iteration."""
import random

import numpy as np
import pytest
from lexivec.operators import lexicon as L
from lexivec.operators import retrofit as R
from lexivec.operators import scoring
from pyspark.sql import functions as F

COLS = scoring.NAMES


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["Good", "bad", "good_NEG", "so", "BAD_NEG", "é", "fine", "Σας", "x"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(0, 40))]) for i in range(60)]
    rows += [(100, []), (101, None), (102, ["good"]), (103, ["good", "bad"]), (104, [None, "good", None])]
    return spark.createDataFrame(rows, "doc_id long, toks array<string>").repartition(3)


def rows_of(df):
    return {r["doc_id"]: [r[c] for c in COLS] for r in df.collect()}


def test_unigram_kernel_like_the_join(spark, docs):
    lex = spark.createDataFrame([("good", 1.5), ("bad", -2.0), ("fine", 0.25), ("é", -0.5), ("so", 0.0), ("none", None), ("σας", 3.0)], "term string, score double")
    a, b = rows_of(L.lexicon_scores(docs, F.col("toks"), lex)), rows_of(L._scores_by_join(docs, F.col("toks"), lex, "doc_id"))
    assert a == b and len(a) == 65 and any(v[0] and v[1] for v in a.values())


def test_pair_kernel_like_the_join(spark, docs):
    lex = spark.createDataFrame([("a", "good", "bad", 1.0), ("b", "bad", "good", -0.5), ("c", "good", "good", 2.0), ("d", "good bad", "fine", 0.75), ("e", "so", "é good", -1.25), ("f", "fine", "so", 0.0), ("g", "x", "x x", 4.0)],
                                "term string, left string, right string, score double")
    keep = docs.where("doc_id <> 104")  # the kernel takes null items for words, the join drops them
    a = rows_of(L.pair_scores(keep, F.col("toks"), lex))
    b = rows_of(L._pairs_by_join(keep, F.col("toks"), lex.select("left", "right", "score"), "doc_id"))
    assert {k: v for k, v in a.items() if k != 101} == {k: v for k, v in b.items() if k != 101} and len(a) == 64
    assert a[101] == [0, 0, 0, 0, 0, 0, 0, 0, 0]


def test_lexicons_beyond_the_bound_are_joined(spark, docs, monkeypatch):
    monkeypatch.setattr(scoring, "bounded_arrow", lambda df: None)
    lex = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "term string, score double")
    assert scoring.unigram_scores(docs, F.col("toks"), lex, "doc_id") is None
    assert L.lexicon_scores(docs, F.col("toks"), lex).count() == 65


def test_repel_like_plain_iteration(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(25, 5))
    cls = [f"c{i % 4}" for i in range(24)] + ["alone"]
    vec = spark.createDataFrame([(f"w{i}", list(map(float, m[i]))) for i in range(25)] + [("out", [1.0] * 5)], "word string, vec array<double>").repartition(3)
    lex = spark.createDataFrame([(f"w{i}", c) for i, c in enumerate(cls)] + [("nowhere", "c0")], "term string, cls string")
    for a, b, c, steps in ((1.0, 1.0, 1.0, 10), (0.5, 0.25, 0.1, 3), (1.0, 1.0, 1.0, 0)):
        q = m.copy()
        for _ in range(steps):
            sums = {k: sum(q[i] for i in range(25) if cls[i] == k) for k in set(cls)}
            total = sum(sums.values())
            n = {k: cls.count(k) - 1 for k in set(cls)}
            q = np.array([(n[k] * a * m[i] + b * (sums[k] - q[i]) - c * (total - sums[k])) / (n[k] * (a + b)) if n[k] else m[i] for i, k in enumerate(cls)])
        got = {(r["word"], r["dim"]): r["value"] for r in R.retrofit_repel(vec, lex, a, b, c, steps).collect()}
        assert len(got) == 125 and all(abs(got[f"w{i}", d] - q[i, d]) <= 1e-6 * max(1, abs(q[i, d])) for i in range(25) for d in range(5))
    assert R.retrofit_repel(vec, lex.where("cls = 'none'")).count() == 0
