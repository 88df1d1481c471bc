"""Readers, writers and helpers on literal files and rows."""

import glob

import pytest
from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.operators import corpus as C
from lexivec.operators import ml as M
from lexivec.operators import vectors as V
from lexivec.sources import readers as RD
from lexivec.sources import sinks as K


def put(tmp_path, text):
    p = tmp_path / "in.txt"
    p.write_text(text, encoding="utf-8")
    return str(p)


def lines(path):
    return sorted(x for f in glob.glob(f"{path}/part-*") for x in open(f, encoding="utf-8").read().splitlines())


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_emotions(spark, tmp_path):
    p = put(tmp_path, "good\tjoy\t1\ngood\tpositive\t1\ngood\tanger\t0\nbad\tanger\t1\nbad\tfear\t1\nbad\tnegative\t1\nodd line\n")
    assert rows(RD.read_nrc_emotion(spark, p), "term", "cls") == [("bad", "negative"), ("good", "positive")]
    assert rows(RD.read_nrc_emotion(spark, p, polarity=False), "term", "cls") == [("bad", "fear"), ("good", "joy")]


def test_clusters_keep_the_last_definition(spark, tmp_path):
    p = put(tmp_path, "0010\tday\t5\n0111\tnight\t3\n1100\tday\t1\n")
    assert rows(RD.read_clusters(spark, p), "word", "cluster") == [("day", "1100"), ("night", "0111")]


def test_simlex(spark, tmp_path):
    p = put(tmp_path, "word1\tword2\tPOS\tSimLex999\nold\tnew\tA\t1.58\ngo\t\"come\tV\t2.42\n")
    assert rows(RD.read_simlex(spark, p), "w1", "w2", "tag", "score") == [("go", '"come', "V", 2.42), ("old", "new", "ADJ", 1.58)]


def test_sentiwordnet_by_part_of_speech(spark, tmp_path):
    p = put(tmp_path, "# head\na\t1\t0.5\t0\tgood#1 fine#2\tg\nn\t2\t0.25\t0.25\tgood#1\tg\na\t3\t0.75\t0.125\tgood#2\tg\n")
    assert rows(RD.read_sentiwordnet(spark, p), "term", "tag", "pos", "neg", "obj") == \
        [("fine", "a", 0.5, 0.0, 0.5), ("good", "a", 0.75, 0.125, 0.125), ("good", "n", 0.25, 0.25, 0.5)]


def test_tags_found_in_vocabulary(spark):
    words = spark.createDataFrame([("run", 1), ("blue", 2), ("zzz", 3)], "word string, i int")
    vocab = spark.createDataFrame([("run___V",), ("run___N",), ("blue___A",)], "word string")
    assert rows(RD.tag_with_vocabulary(words, vocab), "i", "word") == [(1, "run___N"), (2, "blue___A"), (3, None)]


def test_vocabulary_and_prediction_files(spark, tmp_path):
    v = spark.createDataFrame([("a", 2), ("b", 5)], "word string, cnt long")
    K.write_vocab(v, str(tmp_path / "v"))
    assert lines(tmp_path / "v") == ["a\t2", "b\t5"]
    K.write_predictions(spark.createDataFrame([("7", "positive", 1)], "sid string, label string, x int"), str(tmp_path / "p"))
    assert lines(tmp_path / "p") == ["7\tpositive"]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("word,key", [("B2B", "---num---"), ("!?", "---punc---"), ("Été", "été"), ("_", "_")])
def test_word_keys(spark, word, key):
    assert one(spark, T.norm_word("w"), w=word) == key


def test_url_aware_tokens(spark):
    # "://" bears an emoticon, so a URL keeps its case like any such token
    got = one(spark, T.url_aware_tokens("s", preserve_case=False), s="See http://a.b/C?d=1 @Me #Tag :D")
    assert got == ["see", "http://a.b/C?d=1", "@me", "#tag", ":D"]


@pytest.mark.parametrize("toks,want", [([":)", "x"], (1, 0, 0)), (["x", ":("], (0, 1, -1)), ([":(", ":)"], (1, 1, 1))])
def test_emoticons(spark, toks, want):
    assert tuple(one(spark, T.emoticon_features("t", [":)"], [":("]), t=toks)) == want


def test_concatenated_vectors(spark):
    docs = spark.createDataFrame([(1, ["B", "x", "a"]), (2, ["a"])], "doc_id long, t array<string>")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vec array<double>")
    got = {r.doc_id: r.vec for r in V.doc_vectors(docs, F.col("t"), vec, 2).collect()}
    assert got == {1: [3.0, 4.0, 0.0, 0.0, 1.0, 2.0], 2: [1.0, 2.0]}


def test_embedding_matrix(spark):
    index = spark.createDataFrame([("a", 1, 9), ("x", 2, 5), ("b", 3, 1)], "word string, idx long, cnt long")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vec array<double>")
    assert rows(C.embedding_matrix(index, vec, 3, 2), "idx", "vec") == [(1, [1.0, 2.0]), (2, [0.0, 0.0])]


def test_presets(spark):
    cols = M.PRESETS["small"]
    df = spark.createDataFrame([(float(i % 2), 0.0, float(i % 2) - 0.5, "ab"[i % 2]) for i in range(20)], cols + ["label"])
    out = M.classifier_preset("small").fit(df).transform(df)
    assert out.where("target <> prediction").count() == 0
    with pytest.raises(KeyError):
        M.classifier_preset("none")
