"""Readers for the reference's text formats (S1-S25) as DataFrame sources.

All readers are ``spark.read.text``/``csv`` plus column expressions; line
numbers (for "last definition wins" semantics) come from
``monotonically_increasing_id`` over the ordered text splits of one file.
Malformed lines go to a rejects frame instead of duplicating a neighbour (D1).
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lexivec.functions import text as T
from lexivec.operators.lexicon import dedupe_last_wins
from lexivec.operators.ordering import global_index


def _strip(c) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("line_no"))


def read_semeval(spark: SparkSession, path: str, sep: str = "\t", ignore_not_available: bool = True):
    """``sid uid label text`` (4 fields) or ``uid label text`` (3 fields,
    sid null).  Returns ``(rows, rejects)``; label quotes are stripped."""
    raw = _lines(spark, path).select(F.trim("value").alias("l"), "line_no").where(F.col("l") != "")
    p = F.split("l", sep, 4)
    n = F.size(p)
    rows = raw.select(
        F.when(n == 4, p[0]).alias("sid"),
        F.when(n == 4, p[1]).when(n == 3, p[0]).alias("uid"),
        F.regexp_replace(F.when(n == 4, p[2]).when(n == 3, p[1]), '"', "").alias("label"),
        F.when(n == 4, p[3]).when(n == 3, p[2]).alias("text"),
        n.alias("_n"), "line_no", "l")
    good = rows.where(F.col("_n").isin(3, 4))
    if ignore_not_available:
        good = good.where(F.col("text") != "Not Available")
    return good.drop("_n", "l"), rows.where(~F.col("_n").isin(3, 4)).select(F.col("l").alias("line"), "line_no")


def read_bing_liu(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One word per line per class file; blank and ``;`` lines skipped;
    later classes override earlier ones."""
    parts = []
    for prio, (cls, path) in enumerate(paths.items()):
        lines = _lines(spark, path).select(F.trim("value").alias("term"), "line_no")
        parts.append(lines.where((F.col("term") != "") & ~F.col("term").startswith(";"))
                     .select("term", F.lit(cls).alias("cls"), (F.lit(prio) * F.lit(1 << 40) + F.col("line_no")).alias("_o")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return dedupe_last_wins(u, "_o")


def read_mpqa(spark: SparkSession, path: str) -> DataFrame:
    """S3: six space-separated ``k=v`` fields; word = value of field 3,
    polarity = value of field 6 (values may contain ``=``)."""
    f = F.split(F.trim("value"), r"\s+")
    lines = _lines(spark, path).select(f.alias("f"), "line_no").where(F.size("f") == 6)
    val = lambda i: F.regexp_extract(F.col("f")[i], "^[^=]*=(.*)$", 1)
    return dedupe_last_wins(lines.select(val(2).alias("term"), val(5).alias("cls"), "line_no"), "line_no")


def read_two_columns(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """``term<sep>class``, split on the first separator run; without
    ``sep`` on tabs where the line has one, else on white space."""
    own = _strip("value")
    p = F.split(own, sep, 2) if sep else F.when(F.contains(own, F.lit("\t")), F.split(own, r"\t+", 2)).otherwise(F.split(own, r"\s+", 2))
    lines = _lines(spark, path).select(p.alias("p"), "line_no").where(F.size("p") == 2)
    return dedupe_last_wins(lines.select(F.col("p")[0].alias("term"), F.col("p")[1].alias("cls"), "line_no"), "line_no")


SCORE_SCHEMA = Ty.StructType([Ty.StructField("term", Ty.StringType()), Ty.StructField("score", Ty.DoubleType()),
                              Ty.StructField("n_pos", Ty.LongType()), Ty.StructField("n_neg", Ty.LongType())])


def read_nrc_scores(spark: SparkSession, path: str, strict: bool = False, pair: bool = False) -> DataFrame:
    """TSV ``term score n m``; malformed rows dropped (S8) or
    failing (``strict``, S9/S10); a term listed twice keeps its last row.
    ``pair`` splits ``g1---g2`` keys."""
    df = (spark.read.option("sep", "\t").option("quote", "").option("mode", "FAILFAST" if strict else "DROPMALFORMED")
          .schema(SCORE_SCHEMA).csv(path))
    df = dedupe_last_wins(df.withColumn("line_no", F.monotonically_increasing_id()), "line_no")
    if pair:
        parts = F.split("term", "---", 2)
        df = df.withColumn("left", parts[0]).withColumn("right", parts[1])
    return df


def read_nrc_emotion(spark: SparkSession, path: str, polarity: bool = True) -> DataFrame:
    """TSV ``word affect flag``; keep flag 1 and affect in (or, with
    ``polarity=False``, not in) {positive, negative}; last emotion per word."""
    p = F.split("value", "\t")
    lines = _lines(spark, path).select(p.alias("p"), "line_no").where(F.size("p") == 3)
    df = lines.select(F.col("p")[0].alias("term"), F.col("p")[1].alias("cls"),
                      F.col("p")[2].cast("int").alias("flag"), "line_no").where("flag = 1")
    pol = F.col("cls").isin("positive", "negative")
    df = df.where(pol if polarity else ~pol)
    return dedupe_last_wins(df.drop("flag"), "line_no")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """TSV ``cluster word count`` -> ``(word, cluster)``."""
    p = F.split("value", "\t")
    lines = _lines(spark, path).select(p.alias("p"), "line_no").where(F.size("p") == 3)
    return dedupe_last_wins(lines.select(F.col("p")[1].alias("word"), F.col("p")[0].alias("cluster"), "line_no"),
                            "line_no", key="word")


def read_tweet_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``('id', u'ID')<TAB>('text', u'TWEET')``; exactly two tab
    fields, the text is the decoded string literal of the second tuple.  Lines
    that aren't such tuples are skipped."""
    return parse_tweet_log(spark.read.text(path)).select("text")


def parse_tweet_log(lines: DataFrame) -> DataFrame:
    """``(tweet_id, text)`` of a log's lines (column ``value``), batch or
    stream alike; a line whose first tuple names no id has a null one."""
    p = F.split("value", "\t")
    found = F.regexp_extract(F.col("p")[0], r"""^\('id',\s*u?['"]([^'"]*)['"]\)\s*$""", 1)
    rows = lines.select(p.alias("p")).where(F.size("p") == 2)
    rows = rows.select(F.nullif(found, F.lit("")).alias("tweet_id"), _second_literal(F.col("p")[1]).alias("text"))
    return rows.where("text is not null")


def _literal(s: str | None) -> str | None:
    try:
        name, text = ast.literal_eval(s)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    ok = name == "text" and isinstance(text, str)
    return text.encode("utf-8", "replace").decode() if ok else None


@F.pandas_udf(Ty.StringType())
def _second_literal(s: pd.Series) -> pd.Series:
    return s.map(_literal)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines (blank lines kept)."""
    return spark.read.text(path).select(_strip("value").alias("text"))


def read_word_vectors(spark: SparkSession, path: str, normalize: bool = True, header: bool = False, lower: bool | None = None) -> DataFrame:
    """Text vectors ``word v1 ... vd`` (gz read natively); words are
    lower-cased (S16; with ``header``, S17, only if ``lower`` says so) and, with ``normalize``, vectors divided by
    ``sqrt(sum(v^2) + 1e-6)``.  ``header`` skips a word2vec ``n d`` line."""
    from lexivec.operators.vectors import l2_normalize
    p = F.split(F.trim("value"), " ")
    lines = spark.read.text(path).select(p.alias("p"))
    if header:
        lines = lines.where(F.size("p") > 2)
    vec = F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("double"))
    df = lines.select((F.lower(F.col("p")[0]) if (not header if lower is None else lower) else F.col("p")[0]).alias("word"), vec.alias("vec"))
    return df.select("word", l2_normalize(F.col("vec"), 1e-6).alias("vec")) if normalize else df


def read_graph_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """S18 (PPDB): ``word nbr1 nbr2 ...`` -> edges ``(src, dst)`` keyed by
    :func:`norm_word`; the last line of a word wins."""
    p = F.split(F.lower(F.trim("value")), r"\s+")
    lines = _lines(spark, path).select(p.alias("p"), "line_no").where(F.size("p") >= 1)
    src = lines.select(T.norm_word(F.col("p")[0]).alias("src"), F.slice("p", 2, F.size("p")).alias("nb"), "line_no")
    last = src.groupBy("src").agg(F.max_by("nb", "line_no").alias("nb"))
    return last.select("src", F.explode("nb").alias("dst")).select("src", T.norm_word("dst").alias("dst"))


def read_simlex(spark: SparkSession, path: str) -> DataFrame:
    """TSV with header; ``w1 w2 POS score`` (``A`` -> ``ADJ``)."""
    df = spark.read.option("sep", "\t").option("quote", "").option("header", True).csv(path)
    c = df.columns
    return df.select(F.col(c[0]).alias("w1"), F.col(c[1]).alias("w2"),
                     F.when(F.col(c[2]) == "A", "ADJ").otherwise(F.col(c[2])).alias("tag"),
                     F.col(c[3]).cast("double").alias("score"))


def read_analogies(spark: SparkSession, path: str) -> DataFrame:
    """``: section`` lines followed by 4-word questions; each question
    gets its section and that section's number in the file (from 1).

    Sections are carried forward within a partition of lines; a table of one
    row per partition brings the last section of the partitions before it.
    """
    lines = _lines(spark, path).select(_strip("value").alias("l"), "line_no", F.shiftright("line_no", 33).alias("part"))
    head = F.col("l").startswith(":")
    lines = lines.withColumn("own", F.when(head, _strip(F.expr("substring(l, 2)"))))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = lines.groupBy("part").agg(F.count("own").alias("n"), F.max_by("own", F.when(head, F.col("line_no"))).alias("last"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    upto = Window.partitionBy("part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = lines.withColumn("n_own", F.count("own").over(upto)).withColumn("here", F.last("own", ignorenulls=True).over(upto)).join(parts, "part")
    q = at.where(F.col("own").isNull()).select(F.coalesce("here", "carried").alias("section"), (F.col("n_before") + F.col("n_own")).alias("section_no"), F.split("l", r"\s+").alias("w"), "line_no")
    q = q.where((F.size("w") == 4) & F.col("section").isNotNull())
    return q.select("section", "section_no", *[F.col("w")[i].alias(c) for i, c in enumerate("abcd")], "line_no")


def read_word_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Similarity ratings, lines ``w1<TAB>w2<TAB>score``; lines starting
    with ``#`` and lines of another shape are skipped, a pair listed twice
    keeps its last score."""
    p = F.split("value", "\t")
    lines = _lines(spark, path).where(~F.col("value").startswith("#")).select(p.alias("p"), "line_no").where(F.size("p") == 3)
    rows = lines.select(F.struct(F.trim(F.col("p")[0]).alias("w1"), F.trim(F.col("p")[1]).alias("w2")).alias("pair"), F.expr("try_cast(trim(p[2]) AS double)").alias("score"), "line_no")
    last = dedupe_last_wins(rows.where(F.col("score").isNotNull()), "line_no", key="pair")
    return last.select("pair.w1", "pair.w2", "score")


# Lexicon registry -------------------------------------------------------
_REGISTRY: dict[str, tuple] = {}


def register_lexicon(name: str, reader, *args, **kwargs) -> None:
    """Register a named lexicon loader (read on demand, uncached)."""
    _REGISTRY[name] = (reader, args, kwargs)


def register_named_lexicons(places: dict) -> None:
    """Register the known lexicons that ``places`` has: name -> path (for
    ``bing_liu``: class -> path).  Another name raises ``KeyError``."""
    # The names, and which reader and variant each one takes.
    known = {
        "bing_liu": (read_bing_liu, {}),
        "mpqa": (read_mpqa, {}),
        "mpqa_plus": (read_mpqa_plus, {}),
        "nrc_emotion": (read_nrc_emotion, {"polarity": True}),
        "nrc_emotions": (read_nrc_emotion, {"polarity": False}),
        "nrc_hashtag_unigram": (read_nrc_scores, {}),
        "nrc_hashtag_bigram": (read_nrc_scores, {"strict": True}),
        "nrc_hashtag_pair": (read_nrc_scores, {"strict": True, "pair": True}),
        "nrc_hashtag_sentimenthashtags": (read_two_columns, {}),
        "lidilem_adjectifs": (read_lidilem, {"pol_col": 7}),
        "lidilem_noms": (read_lidilem, {"pol_col": 5}),
        "lidilem_verbes": (read_lidilem, {"pol_col": 8}),
        "blogoscopie": (read_two_columns, {"sep": "\t"}),
    }
    for name, place in places.items():
        reader, options = known[name]
        register_lexicon(name, reader, place, **options)


def get_lexicon(spark: SparkSession, name: str) -> DataFrame:
    if name not in _REGISTRY:
        raise KeyError(name)
    reader, args, kwargs = _REGISTRY[name]
    return reader(spark, *args, **kwargs)


def read_mpqa_plus(spark: SparkSession, path: str, row_tag: str = "lexical_entry") -> DataFrame:
    """XML lexicon; per entry ``morpho/name`` -> word and
    ``evaluation/@subtype`` -> polarity, kept when both are present; a word
    listed twice keeps its last entry (Spark's built-in XML source)."""
    df = spark.read.format("xml").option("rowTag", row_tag).load(path)
    rows = df.select(F.trim(F.col("morpho.name").cast("string")).alias("term"),
                     F.col("evaluation._subtype").cast("string").alias("cls"), F.monotonically_increasing_id().alias("entry_no"))
    return dedupe_last_wins(rows.where(F.col("term").isNotNull() & F.col("cls").isNotNull()), "entry_no")


def read_lidilem(spark: SparkSession, path: str, pol_col: int) -> DataFrame:
    """``;``-separated CSV with a header; column 0 is the word and column
    ``pol_col`` the class; empty classes dropped (S5a-c: 7 / 5 / 8)."""
    df = spark.read.option("sep", ";").option("header", True).csv(path)
    c = df.columns
    out = df.select(_strip(F.col(c[0])).alias("term"), _strip(F.col(c[pol_col])).alias("cls"), F.monotonically_increasing_id().alias("line_no"))
    return dedupe_last_wins(out.where(F.col("cls").isNotNull() & (F.col("cls") != "")), "line_no")


def read_anew(spark: SparkSession, path: str) -> DataFrame:
    """TSV ``word nb valence sd arousal sd dominance sd``; lines starting
    with ``Word`` or ``#`` skipped."""
    p = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("Word") & ~F.col("value").startswith("#"))
    lines = lines.select(p.alias("p")).where(F.size("p") >= 8)
    return lines.select(F.col("p")[0].alias("word"), F.col("p")[2].cast("double").alias("valence"),
                        F.col("p")[4].cast("double").alias("arousal"), F.col("p")[6].cast("double").alias("dominance"))


def tag_with_vocabulary(df: DataFrame, vocab: DataFrame, suffixes=("N", "V", "A"), word: str = "word") -> DataFrame:
    """Suffix a word with ``___N``/``___V``/``___A``, the first variant found
    in the vocabulary (coalesced left joins, no per-row lookups)."""
    out = df
    cols = []
    for s in suffixes:
        cand = F.concat(F.col(word), F.lit(f"___{s}"))
        hit = vocab.select(F.col("word").alias(f"_v{s}"))
        out = out.join(hit, cand == F.col(f"_v{s}"), "left")
        cols.append(F.col(f"_v{s}"))
    return out.select(*[c for c in df.columns if c != word], F.coalesce(*cols).alias(word))


def read_sentiwordnet(spark: SparkSession, path: str) -> DataFrame:
    """TSV ``pos id posScore negScore terms gloss``; each ``term#n`` of
    the space-separated terms becomes a row; objective = 1 - (pos + neg); the
    last sense of a term and part of speech wins."""
    p = F.split("value", "\t")
    lines = _lines(spark, path).where(~F.col("value").startswith("#")).select(p.alias("p"), "line_no")
    lines = lines.where(F.size("p") >= 5)
    ex = lines.select(F.col("p")[0].alias("tag"), F.col("p")[2].cast("double").alias("pos"),
                      F.col("p")[3].cast("double").alias("neg"), "line_no",
                      F.explode(F.split(F.trim(F.col("p")[4]), " ")).alias("t"))
    ex = ex.select(F.regexp_replace("t", "#.*$", "").alias("term"), "tag", "pos", "neg",
                   (F.lit(1.0) - F.col("pos") - F.col("neg")).alias("obj"), "line_no")
    return ex.groupBy("term", "tag").agg(*[F.max_by(c, "line_no").alias(c) for c in ("pos", "neg", "obj")])


def read_nrc_class_vectors(spark: SparkSession, path: str, affects: list[str] | None = None) -> DataFrame:
    """Per word, the ordered list of 0/1 flags of the chosen affects
    (file order), for affect-signature relevance."""
    p = F.split("value", "\t")
    lines = _lines(spark, path).select(p.alias("p"), "line_no").where(F.size("p") == 3)
    df = lines.select(F.col("p")[0].alias("word"), F.col("p")[1].alias("affect"),
                      F.col("p")[2].cast("int").alias("flag"), "line_no")
    if affects:
        df = df.where(F.col("affect").isin(*affects))
    g = df.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("line_no", "flag"))).alias("_xs"))
    return g.select("word", F.transform("_xs", lambda x: x["flag"]).alias("flags"))
