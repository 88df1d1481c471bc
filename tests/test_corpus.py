from pyspark.sql import functions as F

from lexivec.operators import corpus as C


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6],)], "ids array<int>")
    out = [r.p for r in df.select(C.pad_sequences(F.col("ids"), 5).alias("p")).collect()]
    assert out[0] == [0, 0, 1, 2, 3]
    out4 = [r.p for r in df.select(C.pad_sequences(F.col("ids"), 4).alias("p")).collect()]
    assert out4[1] == [3, 4, 5, 6]


def test_ngram_ids(spark):
    df = spark.createDataFrame([([1, 4, 9, 4, 1, 4],)], "ids array<int>")
    got = set(df.select(C.distinct_id_ngrams(F.col("ids"), 2).alias("g")).first().g)
    assert got == {"1,4", "4,9", "9,4", "4,1"}


def test_add_ngrams(spark):
    seqs = spark.createDataFrame([(0, [1, 3, 4, 5]), (1, [1, 3, 7, 9, 2])], "doc_id long, ids array<int>")
    d2 = spark.createDataFrame([("1,3", 1337), ("9,2", 42), ("4,5", 2017)], "ngram string, token long")
    out = {r.doc_id: r.ids for r in C.add_ngrams(seqs, "ids", d2, 2).collect()}
    assert out == {0: [1, 3, 4, 5, 1337, 2017], 1: [1, 3, 7, 9, 2, 1337, 42]}
    d3 = d2.unionByName(spark.createDataFrame([("7,9,2", 2018)], "ngram string, token long"))
    out3 = {r.doc_id: r.ids for r in C.add_ngrams(seqs, "ids", d3, 3).collect()}
    assert out3 == {0: [1, 3, 4, 5, 1337], 1: [1, 3, 7, 9, 2, 1337, 2018]}


def test_stratified_split_sizes(spark):
    rows = [(f"a{i:02d}", "c1") for i in range(10)] + [(f"b{i:02d}", "c2") for i in range(5)]
    df = spark.createDataFrame(rows, "term string, cls string")
    s = C.stratified_split(df, "cls", [F.col("term")], 0.9)
    counts = {(r.cls, r.split): r["count"] for r in s.groupBy("cls", "split").count().collect()}
    assert counts == {("c1", "train"): 9, ("c1", "test"): 1, ("c2", "train"): 4, ("c2", "test"): 1}


def test_global_index_matches_sorted_order(spark):
    from lexivec.operators.ordering import global_index
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    g = global_index(df, [F.col("k")], "idx")
    assert all(r.idx == r.k + 1 for r in g.collect())


def test_labels_roundtrip(spark):
    df = spark.createDataFrame([("neutral",), ("positive",)], "label string")
    labs = ["positive", "negative", "neutral"]
    r = df.select(C.encode_labels(F.col("label"), labs).alias("t")).collect()
    assert [x.t for x in r] == [2, 0]
    oh = df.select(C.one_hot(C.encode_labels(F.col("label"), labs), 3).alias("o")).collect()
    assert [x.o for x in oh] == [[0, 0, 1], [1, 0, 0]]


def test_vocabulary_trim_rule(spark):
    docs = spark.createDataFrame([(["a", "b", "b", "c", "c", "c"],)], "tok array<string>")

    def rule(word, cnt):
        return F.when(word == "a", F.lit("keep")).when(word == "c", F.lit("discard"))
    got = {r.word: r.cnt for r in C.vocabulary(docs, F.col("tok"), min_count=2, trim_rule=rule).collect()}
    assert got == {"a": 1, "b": 2}
    assert {r.word for r in C.vocabulary(docs, F.col("tok"), min_count=2).collect()} == {"b", "c"}


def test_dict_vectorize_numeric_and_strings(spark):
    num = spark.createDataFrame([(1, {"b": 2.0, "a": 1.0}), (2, {"c": 3.0}), (3, {})], "doc_id int, f map<string,double>")
    vecs, names = C.dict_vectorize(num, "f")
    assert sorted((r.name, r.idx) for r in names.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    got = {r.doc_id: (r.indices, r.values) for r in vecs.collect()}
    assert got == {1: ([0, 1], [1.0, 2.0]), 2: ([2], [3.0]), 3: ([], [])}
    cat = spark.createDataFrame([(1, {"w-0": "x", "w-1": "y"}), (2, {"w-0": "y"})], "doc_id int, f map<string,string>")
    vecs, names = C.dict_vectorize(cat, "f")
    assert [r.name for r in names.orderBy("idx").collect()] == ["w-0=x", "w-0=y", "w-1=y"]
    got = {r.doc_id: (r.indices, r.values) for r in vecs.collect()}
    assert got == {1: ([0, 2], [1.0, 1.0]), 2: ([1], [1.0])}
