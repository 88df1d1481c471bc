from pyspark.sql import functions as F

from lexivec.operators import lexicon as L


def test_score_block_fixture(spark):
    lex = spark.createDataFrame([("good", "positive"), ("bad", "negative"), ("plain", "neutral")], "term string, cls string")
    docs = spark.createDataFrame([(1, "good bad good_NEG plain".split(" "))], "doc_id long, t array<string>")
    r = L.lexicon_scores(docs, F.col("t"), lex).first()
    assert [r.n_pos, r.n_neg, r.sum_pos, r.sum_neg, r.net, r.max_pos, r.max_neg, r.last_nonzero, r.last_score] == \
        [1, 2, 1.0, 2.0, -1.0, 1.0, 1.0, 1.0, 0.0]


def test_pair_scores_match_enumeration(spark):
    import itertools
    import random
    random.seed(1)
    words = ["a", "b", "c", "d"]
    docs = [(i, [random.choice(words) for _ in range(random.randint(1, 12))]) for i in range(30)]
    pairs = [("a", "b", 1.0), ("b", "a", -0.5), ("c", "c", 2.0), ("d", "a", -1.0)]
    plex = spark.createDataFrame([(f"{l}---{r}", l, r, s) for l, r, s in pairs], "term string, left string, right string, score double")
    ddf = spark.createDataFrame(docs, "doc_id long, t array<string>")
    got = {r.doc_id: (r.n_pos, r.n_neg, r.net) for r in L.pair_scores(ddf, F.col("t"), plex).collect()}
    table = {f"{l}---{r}": s for l, r, s in pairs}
    for doc_id, toks in docs:
        chain = [" ".join(g) for g in zip(toks, toks[1:])] + toks
        hits = [table[f"{x}---{y}"] for x, y in itertools.combinations(chain, 2) if f"{x}---{y}" in table]
        exp = (sum(h > 0 for h in hits), sum(h < 0 for h in hits), round(sum(hits), 6))
        assert got[doc_id] == exp, (doc_id, toks)


def test_projection_and_distant_label(spark):
    lex = spark.createDataFrame([("good", "positive"), ("bad", "negative")], "term string, cls string")
    docs = spark.createDataFrame([(1, ["x", "bad", "good"]), (2, ["x"]), (3, ["good"])], "doc_id long, t array<string>")
    p = {r.doc_id: r.projected for r in L.project_lexicon(docs, F.col("t"), lex).collect()}
    assert p == {1: "x negative positive", 2: "x", 3: "positive"}
    d = {r.doc_id: r.label for r in L.distant_label(docs, F.col("t"), lex.where("cls='positive'"), lex.where("cls='negative'")).collect()}
    assert d == {1: "negatives", 3: "positives"}


def test_union_last_wins(spark):
    a = spark.createDataFrame([("x", "positive"), ("y", "negative")], "term string, cls string")
    b = spark.createDataFrame([("x", "negative")], "term string, cls string")
    assert {r.term: r.cls for r in L.union_last_wins(a, b).collect()} == {"x": "negative", "y": "negative"}
