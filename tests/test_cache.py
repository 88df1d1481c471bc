"""Results cached by parameters and sources, the preprocessing chain, the two
files of a split, and document vectors."""

import random

import pytest
from pyspark.sql import functions as F

from lexivec.operators import vectors as V
from lexivec.operators.tagging import length_tagger
from lexivec.sources import cache


def _numbers(spark, path, times=1):
    return spark.read.text(path).select((F.col("value").cast("int") * times).alias("n"))


def _read(df):
    return sorted(r.n for r in df.collect())


def test_parameters_and_sources_make_the_key(spark, tmp_path):
    src, root, calls = tmp_path / "src.txt", str(tmp_path / "cache"), []
    src.write_text("1\n2\n")

    def build(spark, path, times=1):
        calls.append(times)
        return _numbers(spark, path, times)

    def get(**more):
        return _read(cache.cached(spark, root, build, [str(src)], name="numbers", **more))

    assert get() == [1, 2] and get() == [1, 2] and calls == [1]
    assert get(times=3) == [3, 6] and get() == [1, 2] and calls == [1, 3]
    src.write_text("5\n6\n7\n")
    assert get() == [5, 6, 7] and calls == [1, 3, 1]
    assert get(force=True) == [5, 6, 7] and len(calls) == 4
    with pytest.raises(FileNotFoundError):
        cache.cached(spark, root, build, [str(tmp_path / "none")], name="numbers")


def test_a_build_without_commit_does_not_count(spark, tmp_path):
    src, root = tmp_path / "src.txt", tmp_path / "cache"
    src.write_text("1\n2\n")
    held = cache.cached(spark, str(root), _numbers, [str(src)], name="numbers")
    (base,) = (root / "numbers").iterdir()
    broken = base / "0-broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("half")
    assert _read(cache.cached(spark, str(root), _numbers, [str(src)], name="numbers")) == [1, 2]

    def fails(spark, path):
        return _numbers(spark, path).select(F.assert_true(F.col("n") > 1), "n")

    with pytest.raises(Exception):
        cache.cached(spark, str(root), fails, [str(src)], name="fails")
    assert _read(cache.cached(spark, str(root), _numbers, [str(src)], name="fails")) == [1, 2]
    assert _read(held) == [1, 2]


def test_preprocess_chain(spark, tmp_path):
    src = tmp_path / "semeval.tsv"
    src.write_text('1\tu\t"positive"\tDo not like  http://a.b/c , ok\n2\tu\tobjective\t@me 12 Good\nbroken\n3\tu\tnegative\tNot Available\n')
    got = {r.sid: r for r in cache.preprocess(spark, str(src), tagger=length_tagger).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].label, got["1"].target, got["2"].label, got["2"].target) == ("positive", 0, "neutral", 2)
    assert list(got["1"].tok) == ["Do", "not", "like", "_url_", ",", "ok"] and list(got["2"].tok) == ["_user_", "_number_", "Good"]
    assert list(got["1"].tok_neg) == ["Do", "not", "like_NEG", "_url__NEG", ",", "ok"]
    assert list(got["1"].pos) == ["S", "S", "M", "M", "S", "S"]
    src.write_text("1\tu\tangry\tx\n")
    with pytest.raises(Exception, match="unknown label"):
        cache.preprocess(spark, str(src)).collect()


def test_pretrained_vectors_by_parameters(spark, tmp_path):
    src = tmp_path / "vec.txt"
    src.write_text("a 3 4\nb 0 0\n")
    unit = cache.cached(spark, str(tmp_path / "c"), cache.pretrained_vectors, [str(src)], normalize=True)
    raw = cache.cached(spark, str(tmp_path / "c"), cache.pretrained_vectors, [str(src)], normalize=False)
    assert {r.word: r.vec for r in unit.collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0]}
    assert {r.word: r.vec for r in raw.collect()} == {"a": [3.0, 4.0], "b": [0.0, 0.0]}


def test_train_and_valid_files(spark, tmp_path):
    df = spark.range(40).select("id", F.lit("some text").alias("text")).repartition(3)
    cache.write_train_valid(df, "id", ["id", "text"], str(tmp_path / "t"), str(tmp_path / "v"), 0.25)
    train, valid = ({r.value for r in spark.read.text(str(tmp_path / n)).collect()} for n in ("t", "v"))
    assert len(valid) == 10 and len(train) == 30 and train | valid == {f"{i} some text" for i in range(40)}


def test_document_vectors_both_ways(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice(["A", "b", "hot", "hot", "none", None]) for _ in range(rnd.randrange(30))]) for i in range(50)] + [(98, None), (99, [])]
    rows.append((100, ["hot"] * 5000))
    docs = spark.createDataFrame(rows, "doc_id long, t array<string>").repartition(4)
    table = {"a": [1.0, 2.0], "b": [3.0, -1.0], "hot": [0.5, 0.25]}
    vec = spark.createDataFrame([*table.items(), (None, [9.0, 9.0]), ("none", None)], "word string, vec array<double>")
    want = {i: [x for w in t or [] for x in table.get(w.lower() if w else None, [0.0, 0.0])] for i, t in rows}
    monkeypatch.setattr(V, "BATCH_VALUES", 64)
    for bound in (10, 1):
        got = {r.doc_id: r.vec for r in V.doc_vectors(docs, F.col("t"), vec, 2, max_words=bound).collect()}
        assert got == want
    assert all(v == [0.0] * len(want[i]) for i, v in ((r.doc_id, r.vec) for r in V.doc_vectors(docs, F.col("t"), vec.limit(0), 2).collect()))
    assert "Exchange" not in V.doc_vectors(docs, F.col("t"), vec, 2)._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "").split("MapInArrow")[0]


def test_named_lexicons(spark, tmp_path):
    from lexivec.sources import readers as RD
    files = {"blogoscopie": "bon mot\tpositive\n", "nrc_emotion": "w\tjoy\t1\nw\tpositive\t1\n", "nrc_emotions": "w\tjoy\t1\nw\tpositive\t1\n",
             "nrc_hashtag_pair": "a b---c\t0.5\t1\t2\n", "lidilem_noms": "mot;a;b;c;d;pol\nmal;1;1;1;1;negative\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "pos").write_text("good\n")
    RD.register_named_lexicons({n: str(tmp_path / n) for n in files} | {"bing_liu": {"positive": str(tmp_path / "pos")}})
    got = {n: [(r.term, r["cls"]) for r in RD.get_lexicon(spark, n).collect()] for n in [*files, "bing_liu"] if n != "nrc_hashtag_pair"}
    assert got == {"blogoscopie": [("bon mot", "positive")], "nrc_emotion": [("w", "positive")], "nrc_emotions": [("w", "joy")],
                   "lidilem_noms": [("mal", "negative")], "bing_liu": [("good", "positive")]}
    assert [(r.left, r.right, r.score) for r in RD.get_lexicon(spark, "nrc_hashtag_pair").collect()] == [("a b", "c", 0.5)]
    for name in ("mpqa", "other"):
        with pytest.raises(KeyError):
            RD.get_lexicon(spark, name) if name == "mpqa" else RD.register_named_lexicons({name: "x"})
