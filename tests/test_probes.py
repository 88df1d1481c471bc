"""Cases that once gave wrong rows: tokens, entities, readers, sinks, runs."""

import pytest
from pyspark.sql import functions as F

from lexivec import session
from lexivec.functions import html
from lexivec.functions import text as T
from lexivec.operators import evaluate as E
from lexivec.sources import readers as R
from lexivec.sources import sinks as K


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, tokens", [
    ("3rd 20th 4ever x2", ["3rd", "20th", "4ever", "x2"]),
    ('<a href="x">hi</a>', ['<a href="x">', "hi", "</a>"]),
    ("a < b", ["a", "<", "b"]),
    ("+5 3.5 10:30 1/2", ["+", "5", "3.5", "10:30", "1/2"]),
    ("héllo wörld it's well-known", ["héllo", "wörld", "it's", "well-known"]),
    ("(555) 123-4567 or 555-1234", ["(555) 123-4567", "or", "555-1234"]),
    ("so good :-D (: ... yes", ["so", "good", ":-D", "(:", "...", "yes"]),
    ("@you #topic #a !", ["@you", "#topic", "#", "a", "!"]),
])
def test_tweet_tokens(spark, text, tokens):
    assert one(spark, T.tweet_tokens, text) == tokens


def test_only_emoticons_keep_their_case(spark):
    assert one(spark, lambda c: T.tweet_tokens(c, preserve_case=False), "GOOD :D Day") == ["good", ":D", "day"]


def test_surrogate_and_huge_entities_stay(spark):
    assert one(spark, html.decode_entities, "&#55296; &#233; &#99999999999; &amp; &lt;") == "&#55296; é &#99999999999;  and  <"


def written(tmp_path, *lines):
    path = tmp_path / "in.txt"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_scores_keep_terms_with_quotes(spark, tmp_path):
    path = written(tmp_path, '"\t1.5\t2\t1', '"great\t2.0\t3\t0', "plain\t-1\t0\t4")
    for strict in (False, True):
        assert sorted((r["term"], r["score"]) for r in R.read_nrc_scores(spark, path, strict).collect()) == [('"', 1.5), ('"great', 2.0), ("plain", -1.0)]


def test_tweet_log_decodes_literals_and_skips_others(spark, tmp_path):
    path = written(tmp_path, r"('id', u'1')" + "\t" + r"('text', u'café \x41\\n \'q\' \n')", "('id', u'2')\t('text', u'broken", "('id', u'3')", "('id', u'4')\t('name', u'x')")
    assert [r["text"] for r in R.read_tweet_log(spark, path).collect()] == ["café A\\n 'q' \n"]


def test_two_columns_split_on_tabs_first(spark, tmp_path):
    path = written(tmp_path, "bon marche\tpositif", "mal negatif", "bon marche\tnegatif")
    assert {r["term"]: r["cls"] for r in R.read_two_columns(spark, path).collect()} == {"bon marche": "negatif", "mal": "negatif"}


def test_lidilem_keeps_the_last_definition(spark, tmp_path):
    path = written(tmp_path, "mot;x;pol", "bon;1;pos", "mal;1;neg", "bon;2;neu", "vide;1;")
    assert {r["term"]: r["cls"] for r in R.read_lidilem(spark, path, 2).collect()} == {"bon": "neu", "mal": "neg"}


def test_lines_lose_tabs_and_vectors_keep_case(spark, tmp_path):
    assert [r["text"] for r in R.read_lines(spark, written(tmp_path, "\t a b \t", "")).collect()] == ["a b", ""]
    path = written(tmp_path, "2 2", "Paris 1 0", "paris 0 1")
    assert sorted(r["word"] for r in R.read_word_vectors(spark, path, normalize=False, header=True).collect()) == ["Paris", "paris"]


def test_analogies_carry_their_section(spark, tmp_path):
    path = written(tmp_path, "a b c d", ": capital  cities", "athens greece oslo norway", "bad line", ": family", "boy girl king queen", "he she his her")
    got = [(r["section"], r["a"]) for r in R.read_analogies(spark, path).orderBy("line_no").collect()]
    assert got == [("capital  cities", "athens"), ("family", "boy"), ("family", "he")]


def test_analogy_sections_keep_their_numbers_over_partitions(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for k in range(4):  # a file a partition; the third holds no section line
        lines = [f"x{k}{i} b c d" for i in range(2)]
        (tmp_path / "many" / f"part-{k}").write_text("\n".join(lines if k == 2 else [lines[0], f": s{9 - k}", lines[1]]) + "\n")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        got = [(r["section"], r["section_no"], r["a"]) for r in R.read_analogies(spark, str(tmp_path / "many")).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    files = [[a for _, _, a in got if a[1] == k] for k in "0123"]
    order = sorted("0123", key=lambda k: min([n for n, g in enumerate(got) if g[2][1] == k], default=99))
    want, section, no = [], None, 0
    for k in order:
        for i in range(2):
            if i == 1 and k != "2":
                section, no = f"s{9 - int(k)}", no + 1
            if section:
                want.append((section, no, f"x{k}{i}"))
    assert got == want and files


def test_semantic_sections_are_the_first_of_the_file(spark):
    from lexivec.operators import vectors as V
    vecs = spark.createDataFrame([(w, [float(i + 1), float((i * 7) % 5), 1.0]) for i, w in enumerate("abcdefgh")], "word string, vec array<double>")
    q = spark.createDataFrame([(f"q{n}", s, n, "a", "b", "c", "d") for n, s in enumerate(["zoo", "yak", "ant"], 1)], "qid string, section string, section_no long, a string, b string, c string, d string")
    kinds = {r["section"]: r["kind"] for r in V.analogy_accuracy(q, vecs, 2).collect()}
    assert kinds == {"zoo": "semantic", "yak": "semantic", "ant": "syntactic"}


def test_scores_keep_the_last_definition(spark, tmp_path):
    path = written(tmp_path, "good\t1.0\t3\t1", "bad\t-1.0\t0\t2", "good\t2.0\t4\t1")
    for strict in (False, True):
        assert {r["term"]: (r["score"], r["n_pos"]) for r in R.read_nrc_scores(spark, path, strict).collect()} == {"good": (2.0, 4), "bad": (-1.0, 0)}
    pairs = written(tmp_path, "a---b\t1.0\t3\t1", "a---b\t-2.0\t3\t1")
    assert [(r["left"], r["right"], r["score"]) for r in R.read_nrc_scores(spark, pairs, pair=True).collect()] == [("a", "b", -2.0)]
    entry = "<lexical_entry><morpho><name>{}</name></morpho><evaluation subtype='{}'/></lexical_entry>"
    xml = written(tmp_path, "<lexicon>", entry.format("bon", "positive"), entry.format("mal", "negative"), entry.format("bon", "neutral"), "</lexicon>")
    assert {r["term"]: r["cls"] for r in R.read_mpqa_plus(spark, xml).collect()} == {"bon": "neutral", "mal": "negative"}


def test_word_pairs(spark, tmp_path):
    path = written(tmp_path, "# Word 1\tWord 2\tHuman", "love\tsex\t6.77", "tiger \tcat\t7.35", "short line", "tiger\tcat\t7.5", "a\tb\tnot a number")
    assert sorted(tuple(r) for r in R.read_word_pairs(spark, path).collect()) == [("love", "sex", 6.77), ("tiger", "cat", 7.5)]


def test_class_list_in_pieces(spark):
    from lexivec.operators.similarity import with_pieces
    words, classes = spark.range(5), spark.createDataFrame([(f"c{i % 40}",) for i in range(100)], "cls string")
    for piece in (1000, 7, 1):
        got = with_pieces(words, classes, "cls", piece)
        assert got.count() == got.distinct().count() == 200
    assert with_pieces(words, classes.limit(0), "cls").count() == 0
    assert "CartesianProduct" not in with_pieces(words, classes, "cls")._jdf.queryExecution().executedPlan().toString()


def test_graph_lines_keep_all_neighbours(spark, tmp_path):
    path = written(tmp_path, "hub " + " ".join(f"n{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "alone")
    assert R.read_graph_lexicon(spark, path).count() == 300


def test_qrels_and_cache_are_written(spark, tmp_path):
    lex = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "term string, cls string")
    K.write_qrels(E.qrels(lex), str(tmp_path / "q"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "q")).collect()) == ["a 0 x 2", "b 0 x 2", "c 0 y 1"]
    for n in (1, 2):  # the second time from the cache, with a source that is missing
        got = K.materialize(spark, str(tmp_path / "m"), lambda: spark.range(n), [str(tmp_path / "none"), written(tmp_path, "x") if n == 1 else str(tmp_path / "q0")])
    assert got.count() == 1


def test_filtered_runs_are_ranked_anew(spark):
    run = spark.createDataFrame([("q", "B2", 1, .9), ("q", "good", 2, .8), ("q", "good", 5, .1), ("q", "fine", 4, .3)], "query string, word string, rank int, sim double")
    assert [tuple(r) for r in E.filter_run(run).orderBy("rank").collect()] == [("q", "good", 1, .8), ("q", "fine", 2, .3)]


def test_only_local_masters_get_a_folder_of_their_own():
    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn") and not session.is_local(None)
