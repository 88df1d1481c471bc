import os
import tempfile

from lexivec.sources import readers as RD
from lexivec.sources import sinks as K


def _file(text):
    d = tempfile.mkdtemp(prefix="lexivec-src-", dir="/tmp")
    p = os.path.join(d, "in.txt")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_semeval_reader(spark):
    p = _file('1\tu1\t"positive"\tI do not like it . no way\n2\tu1\tneutral\tNot Available\n'
              'u2\tnegative\tso baaaad !!!\n\nbroken line\n')
    rows, rejects = RD.read_semeval(spark, p)
    got = {(r.sid, r.uid, r.label, r.text) for r in rows.collect()}
    assert got == {("1", "u1", "positive", "I do not like it . no way"), (None, "u2", "negative", "so baaaad !!!")}
    assert [r.line for r in rejects.collect()] == ["broken line"]


def test_lexicon_readers(spark):
    pos = _file("; comment\ngood\n\nnice\n")
    neg = _file("bad\nnice\n")
    got = {r.term: r.cls for r in RD.read_bing_liu(spark, {"positive": pos, "negative": neg}).collect()}
    assert got == {"good": "positive", "nice": "negative", "bad": "negative"}
    mp = _file("type=weaksubj len=1 word1=abandon pos1=verb stemmed1=y priorpolarity=negative\nbad line\n")
    assert [(r.term, r.cls) for r in RD.read_mpqa(spark, mp).collect()] == [("abandon", "negative")]


def test_vectors_roundtrip(spark):
    df = spark.createDataFrame([("Word", [3.0, 4.0])], "word string, vec array<double>")
    d = tempfile.mkdtemp(prefix="lexivec-vec-", dir="/tmp")
    K.write_word_vectors(df, d + "/v")
    r = RD.read_word_vectors(spark, d + "/v").first()
    assert r.word == "word" and abs(r.vec[0] - 3.0 / (25 + 1e-6) ** 0.5) < 1e-12


def test_stream_equals_batch(spark):
    from pyspark.sql import functions as F
    from lexivec.functions import text as T
    from lexivec.operators import lexicon as L
    from lexivec.streaming.label_stream import label_stream
    d = tempfile.mkdtemp(prefix="lexivec-stream-", dir="/tmp")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a good day", "so bad", "nothing", "bad then good"])],
                                 "doc_id long, text string")
    docs.repartition(2).write.parquet(d + "/docs")
    lex = spark.createDataFrame([("good", "positive"), ("bad", "negative")], "term string, cls string")
    pos, neg = lex.where("cls='positive'"), lex.where("cls='negative'")
    s = {(r.doc_id, r.label) for r in label_stream(spark, d + "/docs", docs.schema, pos, neg).collect()}
    b = {(r.doc_id, r.label) for r in L.distant_label(docs.select("doc_id", T.tokens(T.normalize_text("text")).alias("t")),
                                                       F.col("t"), pos, neg).collect()}
    assert s == b == {(0, "positives"), (1, "negatives"), (3, "negatives")}


def test_more_readers(spark):
    anew = _file("Word\tNo\tValMn\tValSD\tAroMn\tAroSD\tDomMn\tDomSD\n# c\nlove\t1\t8.7\t0.1\t6.4\t0.2\t5.9\t0.3\n")
    r = RD.read_anew(spark, anew).first()
    assert (r.word, r.valence, r.arousal, r.dominance) == ("love", 8.7, 6.4, 5.9)
    swn = _file("# header\na\t001\t0.5\t0.25\tgood#1 fine#2\tgloss\na\t002\t0.0\t0.75\tgood#3\tgloss2\n")
    got = {r.term: (r.pos, r.neg, r.obj) for r in RD.read_sentiwordnet(spark, swn).collect()}
    assert got == {"good": (0.0, 0.75, 0.25), "fine": (0.5, 0.25, 0.25)}
    lid = _file("mot;a;b;c;d;e;f;pol\nbon;1;1;1;1;1;1;positive\nneutre;1;1;1;1;1;1;\n")
    assert [(r.term, r.cls) for r in RD.read_lidilem(spark, lid, 7).collect()] == [("bon", "positive")]
    xml = _file("<lexicon><lexical_entry><morpho><name>happy</name></morpho><evaluation subtype='positive'/></lexical_entry>"
                "<lexical_entry><morpho><name>odd</name></morpho></lexical_entry></lexicon>")
    assert [(r.term, r.cls) for r in RD.read_mpqa_plus(spark, xml).collect()] == [("happy", "positive")]
    nrc = _file("abandon\tfear\t1\nabandon\tjoy\t0\nzeal\tfear\t0\n")
    got = {r.word: r.flags for r in RD.read_nrc_class_vectors(spark, nrc, ["fear", "joy"]).collect()}
    assert got == {"abandon": [1, 0], "zeal": [0]}


def test_feature_maps(spark):
    from pyspark.sql import functions as F
    from lexivec.functions import text as T
    df = spark.createDataFrame([([[1.0, 2.0], [3.0]], "a  b")], "x array<array<double>>, s string")
    r = df.select(T.array_to_feature("x", "f").alias("m"), T.string_to_feature(F.col("s"), "w").alias("w")).first()
    assert r.m == {"f-0-0": 1.0, "f-0-1": 2.0, "f-1-0": 3.0} and r.w == {"w-0": "a", "w-1": "b"}
