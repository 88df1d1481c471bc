"""Evaluation operators against brute-force Python on small fixtures."""

import math

from pyspark.sql import functions as F

from lexivec.operators import evaluate as E

LEX = [("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", "y"), ("f", "z")]
# run: (query, word, rank), self excluded as in kNN
RUN = [("a", "d", 1), ("a", "b", 2), ("a", "c", 3),
       ("b", "a", 1), ("b", "e", 2), ("b", "f", 3),
       ("d", "e", 1), ("d", "a", 2), ("d", "b", 3),
       ("f", "a", 1), ("f", "b", 2), ("f", "c", 3)]


def brute(lex, run, k, include_query):
    cls = dict(lex)
    size = {c: sum(1 for _, x in lex if x == c) for c in set(cls.values())}
    out = {}
    for q in sorted({r[0] for r in run}):
        if q not in cls:
            continue
        n_rel = size[cls[q]] - (0 if include_query else 1)
        if n_rel <= 0:
            continue
        rows = sorted((r for r in run if r[0] == q), key=lambda r: r[2])
        rel = [1 if cls.get(w) == cls[q] else 0 for _, w, _ in rows]
        cum, ap, rr, dcg = 0, 0.0, 0.0, 0.0
        for i, r in enumerate(rel, 1):
            if r:
                cum += 1
                ap += cum / i
                rr = rr or 1.0 / i
                dcg += 1.0 / math.log2(i + 1)
        ideal = sum(1.0 / math.log2(i + 1) for i in range(1, min(n_rel, k) + 1))
        out[q] = (round(sum(rel[:1]) / 1.0, 6), round(ap / n_rel, 6), round(rr, 6), round(dcg / ideal, 6))
    return out


def metrics(spark, include_query):
    lex = spark.createDataFrame(LEX, "term string, cls string")
    run = spark.createDataFrame(RUN, "query string, word string, rank int")
    m = E.ir_metrics(run, lex, 3, include_query=include_query)
    return {r["query"]: (r["p1"], r["ap"], r["rr"], r["ndcg"]) for r in m.collect()}


def test_ir_metrics_class_relevance(spark):
    assert metrics(spark, True) == brute(LEX, RUN, 3, True)


def test_ir_metrics_query_excluded(spark):
    got = metrics(spark, False)
    assert got == brute(LEX, RUN, 3, False)
    assert "f" not in got  # a singleton class has nothing relevant once the query is left out


def test_signature_lexicon_and_qrels(spark):
    flags = spark.createDataFrame(
        [("w1", [1, 0, 1]), ("w2", [1, 0, 1]), ("w3", [0, 0, 0]), ("w4", [0, 1, 0]), ("w5", [1, 0, 1])],
        "word string, flags array<int>")
    sig = E.signature_lexicon(flags)
    assert sorted(map(tuple, sig.collect())) == [("w1", "101"), ("w2", "101"), ("w4", "010"), ("w5", "101")]
    q = E.qrels(sig, include_query=False)
    assert sorted((r["qid"], r["num_rel"]) for r in q.collect()) == [("w1", 2), ("w2", 2), ("w5", 2)]
    q_all = E.qrels(sig)
    assert sorted((r["qid"], r["num_rel"]) for r in q_all.collect()) == [("w1", 3), ("w2", 3), ("w4", 1), ("w5", 3)]


def test_classification_report_brute(spark):
    P, N, U = "positive", "negative", "neutral"
    rows = [(P, P), (P, N), (N, N), (U, P), (N, N), (P, P)]
    df = spark.createDataFrame(rows, "gold string, pred string")
    rep = {r["cls"]: r for r in E.classification_report(df).collect()}
    for c in (P, N, U):
        tp = sum(1 for g, p in rows if g == c and p == c)
        npred = sum(1 for _, p in rows if p == c)
        sup = sum(1 for g, _ in rows if g == c)
        p = tp / npred if npred else 0.0
        r = tp / sup if sup else 0.0
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        assert (rep[c]["precision"], rep[c]["recall"], rep[c]["f1"], rep[c]["support"]) == \
            (round(p, 6), round(r, 6), round(f1, 6), sup)
    score = E.semeval_score(E.classification_report(df)).collect()[0][0]
    assert abs(score - (rep[P]["f1"] + rep[N]["f1"]) / 2) < 1e-6
    assert df.select(F.count("*")).first()[0] == len(rows)


def test_sized_broadcast_bounds(spark):
    from lexivec.session import sized_broadcast
    df = spark.createDataFrame([(i, "w" * 10, [1.0] * 4) for i in range(50)], "k int, s string, v array<double>")

    def hinted(d):
        return "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(sized_broadcast(df))
    assert not hinted(sized_broadcast(df, max_rows=49))
    # 50 rows x (16 + 8 + 10 + 32) bytes = 3300 bytes
    assert hinted(sized_broadcast(df, max_bytes=3300))
    assert not hinted(sized_broadcast(df, max_bytes=3299))


def test_checkpointed_releases_cache_and_keeps_rows(spark):
    from lexivec.session import checkpointed
    df = spark.range(0, 1000).withColumn("sq", F.col("id") * F.col("id")).orderBy(F.col("id").desc())
    out = checkpointed(df)
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in df.collect()]
    assert not df.is_cached
    # the result reads the checkpoint files, not the original plan
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
