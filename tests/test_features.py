"""Sparse feature blocks against a plain dictionary version; pair block against enumeration."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import evaluate as E
from lexivec.operators import features as X
from lexivec.operators import lexicon as L
from lexivec.operators import retrofit as R
from lexivec.operators import vectors as V

DOCS = [(1, "No way, GREAT day"), (2, "great great"), (3, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def table(df):
    return {(r.doc_id, r.name): r.value for r in df.collect()}


def test_word_ngrams_presence(docs):
    got = table(X.word_ngram_features(docs, F.col("text"), 1, 2))
    assert got == {(1, g): 1.0 for g in ("no", "way", "great", "day", "no way", "way great", "great day")} | \
        {(2, g): 1.0 for g in ("great", "great great")}


def test_char_ngrams_presence(docs):
    got = table(X.char_ngram_features(docs.where("doc_id = 2"), F.col("text"), 3, 3))
    assert {n for _, n in got} == {"gre", "rea", "eat", "at ", "t g", " gr"}


def test_tags_are_counted(spark):
    d = spark.createDataFrame([(1, ["NN", "VB", "NN", "."])], "doc_id long, tag array<string>")
    assert table(X.tag_counts(d, F.col("tag"))) == {(1, "nn"): 2.0, (1, "vb"): 1.0}


def test_clusters(spark, docs):
    c = spark.createDataFrame([("great", "C1"), ("day", "C1")], "word string, cluster string")
    toks = F.split("text", " ")
    assert table(X.cluster_features(docs.where("doc_id < 3"), toks, c)) == \
        {(1, "c1"): 1.0, (1, "not_found"): 1.0, (2, "c1"): 1.0}
    assert table(X.cluster_features(docs.where("doc_id < 3"), toks, c, None)) == {(1, "c1"): 1.0, (2, "c1"): 1.0}


def test_union_and_scaling(spark):
    dense = X.dense_block(spark.createDataFrame([(1, 2.0, 0.0), (2, -4.0, 0.0)], "doc_id long, b double, a double"), ["b", "a"])
    sparse = spark.createDataFrame([(1, "x", 3.0), (2, "a", 1.0)], "doc_id long, name string, value double")
    entries, names = X.feature_union({"dense": dense, "sparse": sparse})
    # a column that is zero everywhere keeps its index but gives no entry
    assert [(r.block, r.name) for r in names.orderBy("idx").collect()] == \
        [("dense", "a"), ("dense", "b"), ("sparse", "a"), ("sparse", "x")]
    got = {(r.doc_id, r.idx): r.value for r in X.max_abs_scaled(entries).collect()}
    assert got == {(1, 1): 0.5, (2, 1): -1.0, (1, 3): 1.0, (2, 2): 1.0}


def test_unit_rows(spark):
    b = spark.createDataFrame([(1, "x", 3.0), (1, "y", 4.0), (2, "x", 0.0)], "doc_id long, name string, value double")
    assert table(X.unit_rows(b)) == {(1, "x"): 0.6, (1, "y"): 0.8, (2, "x"): 0.0}


def test_pair_block_with_negation(spark):
    rng = random.Random(3)
    words = ["a", "b", "a_NEG", "b_NEG", "c"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(1, 9))]) for i in range(40)]
    lex = {("a", "b"): 1.0, ("b", "a"): -0.5, ("c", "c"): 2.0, ("a b", "c"): 0.25, ("c", "a"): 0.0}
    plex = spark.createDataFrame([(f"{x}---{y}", x, y, s) for (x, y), s in lex.items()],
                                 "term string, left string, right string, score double")
    got = {r.doc_id: list(r)[1:] for r in
           L.pair_scores(spark.createDataFrame(rows, "doc_id long, t array<string>"), F.col("t"), plex).collect()}
    for doc, t in rows:
        chain = [" ".join(g) for g in zip(t, t[1:])] + t
        scores = []
        for x, y in itertools.combinations(chain, 2):
            s = lex.get((x.replace("_NEG", ""), y.replace("_NEG", "")))
            scores.append(None if s is None else -s if "_NEG" in x + y else s)
        pos, neg = [s for s in scores if s and s > 0], [-s for s in scores if s and s < 0]
        nonzero = [abs(s) for s in scores if s]
        want = [len(pos), len(neg), sum(pos), sum(neg), sum(pos) - sum(neg), max(pos, default=0), max(neg, default=0),
                nonzero[-1] if nonzero else 0, (scores[-1] or 0) if scores else 0]
        assert got[doc] == pytest.approx(want), (doc, t)


def vectors(spark, n, seed=0, dim=4):
    # few distinct values, so that many cosines tie
    v = np.random.default_rng(seed).integers(-1, 2, (n, dim)).astype(float)
    return v, spark.createDataFrame([(f"w{i:03}", list(map(float, r))) for i, r in enumerate(v)], "word string, vec array<double>")


@pytest.mark.parametrize("rows,cols", [(4096, 1024), (5, 3)])
def test_knn_blocks_and_ties(spark, rows, cols):
    v, df = vectors(spark, 60)
    u = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    got = {}
    for r in V.knn(df.repartition(3), df, 7, row_block=rows, query_block=cols).collect():
        got.setdefault(r.query, {})[r["rank"]] = (r.word, r.sim)
    for i in range(60):
        sims = u @ u[i]
        best = [got[f"w{i:03}"][k + 1] for k in range(7)]
        want = sorted((-sims[j], j) for j in range(60) if j != i)[:7]
        assert [s for _, s in best] == pytest.approx([-s for s, _ in want])
        assert f"w{i:03}" not in [w for w, _ in best]


def test_class_scores_of_unknown_words_and_empty_lexicon(spark):
    _, df = vectors(spark, 5, seed=1)
    lex = spark.createDataFrame([("w000", "p"), ("w001", "n")], "term string, cls string")
    ask = spark.createDataFrame([("w002",), ("zzz",)], "word string")
    got = {(r.word, r.cls): r.score for r in V.closest_class_scores(df, lex, words=ask).collect()}
    assert set(got) == {(w, c) for w in ("w002", "zzz") for c in "pn"}
    assert got["zzz", "p"] == got["zzz", "n"] == -1.0
    none = spark.createDataFrame([("nowhere", "p")], "term string, cls string")
    assert V.closest_class_scores(df, none).count() == 0


def test_spill_in_every_iteration(spark):
    v = np.random.default_rng(5).normal(size=(6, 3))
    words, cls = [f"w{i}" for i in range(6)], ["p", "p", "p", "n", "n", None]
    near = [("w0", "w5"), ("w1", "w5"), ("w3", "w0"), ("w4", "w2")]
    df = spark.createDataFrame([(w, x.tolist()) for w, x in zip(words, v)], "word string, vec array<double>")
    lex = spark.createDataFrame([(w, c) for w, c in zip(words, cls) if c], "term string, cls string")
    out = R.retrofit_spill(df, lex, spark.createDataFrame(near, "query string, word string"), 0.5, 0.5, 0.3, 3)
    got = {(r.word, r.dim): r.value for r in out.collect()}
    q, n = v.copy(), {"p": 2, "n": 1}
    sums = lambda q: {c: sum(q[i] for i in range(6) if cls[i] == c) for c in n}
    last = {"w5": "w1", "w0": "w3", "w2": "w4"}
    for _ in range(3):
        s = sums(q)
        q = np.array([(n[c] * 0.5 * v[i] + 0.5 * (s[c] - q[i])) / n[c] if c else q[i] for i, c in enumerate(cls)])
        s, new = sums(q), q.copy()
        for k, src in last.items():
            k, i = words.index(k), words.index(src)
            new[k] = 0.3 * (0.3 * n[cls[i]] * 0.5 * v[k] + 0.5 * (s[cls[i]] - q[i]))
        q = new
    assert got == pytest.approx({(w, d): q[i][d] for i, w in enumerate(words) for d in range(3)}, abs=2e-6)


def test_full_metrics(spark):
    lex = spark.createDataFrame([("q", "p"), ("a", "p"), ("b", "p"), ("x", "n"), ("y", "n")], "term string, cls string")
    run = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("q", "y", 4)], "query string, word string, rank int")
    r = E.ir_metrics(run, lex, 4, cutoffs=(1, 2, 1000), full=True).first()
    assert [r.p1, r.p2, r.p1000, r.num_rel, r.num_rel_ret] == [1.0, 0.5, 0.002, 3.0, 2.0]
    assert [r.recall, r.rprec, r.bpref] == pytest.approx([2 / 3] * 3, abs=1e-6)


@pytest.mark.parametrize("metric,best", [("mean_ap", "hi"), ("acc", "hi"), ("val_fmeasure", "hi"), ("loss", "lo"), ("odd_name", "lo")])
def test_direction_of_best(spark, metric, best):
    df = spark.createDataFrame([("t", "lo", 0.1), ("t", "hi", 0.9)], f"test string, train string, {metric} double")
    assert E.best_of(df, metric, ["test"], ["train"]).first()["train"] == best
