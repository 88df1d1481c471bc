from pyspark.sql import functions as F

from lexivec.functions import text as T


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_number_replacement(spark):
    assert one(spark, T.replace_numbers, "1,234,567") == "_number__number_"
    assert one(spark, T.replace_numbers, "-5 a-5") == "-_number_ a_number_"
    assert one(spark, T.replace_numbers, ",12 x23 é12") == ",_number_ x23 é12"


def test_user_and_url_replacement(spark):
    assert one(spark, T.replace_users, "@abcé @bob.") == "@abcé _user_."
    assert one(spark, T.replace_urls, "see http://t.co/a?b=1. ok") == "see _url_. ok"
    assert one(spark, T.replace_urls, "éhttp://x.y") == "éhttp://x.y"
    assert one(spark, T.replace_numbers, "see http://t.co/a?b=1. ok") == "see http://t.co/a?b=_number_. ok"


def test_collapse_and_split(spark):
    assert one(spark, T.collapse_space, "a \n\t b  ") == "a b "
    assert one(spark, lambda c: T.split_tokens(c), "a  b ") == ["a", "", "b", ""]


def test_token_features(spark):
    toks = lambda s: s.split(" ")
    df = spark.createDataFrame([(toks("sooo go aaa AAa"), toks("ABC A1 12 aB ÉÀ"))], "a array<string>, b array<string>")
    r = df.select(T.count_elongated("a").alias("e"), T.count_all_caps("b").alias("c")).first()
    assert (r.e, r.c) == (2, 3)
    p = one(spark, T.punctuation_features, "a!!! b!! c!!")
    assert p["excl_runs"] == 3 and p["last_excl_quest"] == 1


def test_negation_marking(spark):
    toks = "i do not like it . no way".split(" ")
    df = spark.createDataFrame([(toks,), ("no, way".split(" "),)], "t array<string>")
    out = [r.m for r in df.select(F.array_join(T.mark_negation("t"), " ").alias("m")).collect()]
    assert out == ["i do not like_NEG it_NEG . no way_NEG", "no, way"]
    n = [r.n for r in df.select(T.count_negated_contexts("t").alias("n")).collect()]
    assert n == [2, 1]


def test_negation_long_document_is_linear(spark):
    toks = (["not"] + ["w"] * 9 + ["."]) * 2000  # 22,000 tokens
    df = spark.createDataFrame([(toks,)], "t array<string>")
    r = df.select(F.size(F.filter(T.mark_negation("t"), lambda w: w.endswith("_NEG"))).alias("n")).first()
    assert r.n == 9 * 2000


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "t array<string>")
    out = [r.g for r in df.select(T.ngrams("t", 2).alias("g")).collect()]
    assert out == [["a b", "b c"], []]
    assert one(spark, lambda c: T.char_ngrams(c, 3), "Ab  c") == ["ab ", "b c"]


def test_tweet_tokens(spark):
    s = "RT @user: loving #spark :-) so much!!! http://x.co 555-123-4567"
    toks = one(spark, lambda c: T.tweet_tokens(c, preserve_case=False), s)
    assert "@user" in toks and "#spark" in toks and ":-)" in toks and "555-123-4567" in toks


def test_html_entities(spark):
    from lexivec.functions.html import decode_entities
    assert one(spark, decode_entities, "a &lt;b&gt; &#65; &amp; c") == "a <b> A  and  c"
