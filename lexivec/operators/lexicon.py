"""Lexicon operators: projection, distant labelling and the lexicon score block.

Lexicons are small tables ``(term, cls)`` or ``(term, score)``; they are joined
with a size-checked broadcast, so the token side streams through the join and
the per-document aggregate without any token-level shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.operators import scoring
from lexivec.operators.lookup import lookup_tokens
from lexivec.operators.ordering import global_index
from lexivec.session import sized_broadcast

# Class names and their scores in categorical lexicons.
CLASS_SCORES = {"positive": 1.0, "negative": -1.0, "neutral": 0.0, "both": 0.0}


def class_to_score(cls: Column) -> Column:
    """positive=1, negative=-1, neutral/both=0, anything else null (skipped)."""
    out = F.lit(None).cast("double")
    for name, val in reversed(list(CLASS_SCORES.items())):
        out = F.when(cls == name, F.lit(val)).otherwise(out)
    return out


def scored(lexicon: DataFrame) -> DataFrame:
    """Normalise a lexicon to ``(term, score)``: numeric score wins, else class."""
    if "score" in lexicon.columns and "cls" not in lexicon.columns:
        return lexicon.select("term", F.col("score").cast("double").alias("score"))
    if "score" in lexicon.columns:
        return lexicon.select("term", F.col("score").cast("double").alias("score"))
    return lexicon.select("term", class_to_score(F.col("cls")).alias("score"))


def dedupe_last_wins(lexicon: DataFrame, order_col: str, key: str = "term") -> DataFrame:
    """Readers keep the last definition of a key (dict semantics): ``max_by``."""
    vals = [c for c in lexicon.columns if c not in (key, order_col)]
    return lexicon.groupBy(key).agg(*[F.max_by(c, order_col).alias(c) for c in vals])


def lexicon_scores(docs: DataFrame, items: Column, lexicon: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A4: nine-value lexicon block per document.

    ``items`` is an array column of (possibly ``_NEG``-marked) tokens or n-grams.
    Items are lower-cased and looked up without their ``_NEG`` mark; a negated
    item flips the sign of its score (D6 fixed).  Output per document:
    n_pos, n_neg (score 0 counts in neither), sum_pos, sum_neg (absolute),
    net, max_pos, max_neg (absolute), last_nonzero (absolute score of the last
    scored item) and last_score (signed score of the last item, 0 if none).

    Plan: a lexicon of proven size comes to the documents, which stay where
    they are (:mod:`lexivec.operators.scoring`).  Any other: posexplode, join,
    hash aggregate by document; the aggregate is partial before the shuffle.
    """
    held = scoring.unigram_scores(docs, items, scored(lexicon), id_col)
    return held if held is not None else _scores_by_join(docs, items, lexicon, id_col)


def _scores_by_join(docs: DataFrame, items: Column, lexicon: DataFrame, id_col: str) -> DataFrame:
    """:func:`lexicon_scores` with the lexicon as a table of any size."""
    lex = sized_broadcast(scored(lexicon).where(F.col("score").isNotNull())
                          .select(F.col("term").alias("_key"), F.col("score").alias("_score")))
    exploded = docs.select(F.col(id_col), F.posexplode_outer(items).alias("_pos", "_item"))
    keyed = exploded.select(id_col, "_pos",
                            F.coalesce(F.col("_item").contains(T.NEG_SUFFIX), F.lit(False)).alias("_neg"),
                            F.lower(F.regexp_replace("_item", T.NEG_SUFFIX, "")).alias("_key"))
    hits = keyed.join(lex, "_key", "left")
    s = F.when(F.col("_neg"), -F.col("_score")).otherwise(F.col("_score"))
    hits = hits.select(id_col, "_pos", s.alias("s"))
    pos, neg = F.col("s") > 0, F.col("s") < 0
    agg = hits.groupBy(id_col).agg(
        F.count_if(pos).alias("n_pos"),
        F.count_if(neg).alias("n_neg"),
        F.coalesce(F.sum(F.when(pos, F.col("s"))), F.lit(0.0)).alias("sum_pos"),
        F.coalesce(F.sum(F.when(neg, -F.col("s"))), F.lit(0.0)).alias("sum_neg"),
        F.coalesce(F.max(F.when(pos, F.col("s"))), F.lit(0.0)).alias("max_pos"),
        F.coalesce(F.max(F.when(neg, -F.col("s"))), F.lit(0.0)).alias("max_neg"),
        F.coalesce(F.max_by(F.abs("s"), F.when(F.col("s") != 0, F.col("_pos"))), F.lit(0.0)).alias("last_nonzero"),
        F.coalesce(F.max_by(F.coalesce(F.col("s"), F.lit(0.0)), F.col("_pos")), F.lit(0.0)).alias("last_score"),
    )
    r = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return agg.select(id_col, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                      r("sum_pos"), r("sum_neg"), F.round(F.col("sum_pos") - F.col("sum_neg"), 6).alias("net"),
                      r("max_pos"), r("max_neg"), r("last_nonzero"), r("last_score"))


def _count_before(left: Column, right: Column) -> Column:
    """Number of pairs with a left position below a right one, both arrays
    sorted.  Encoded as one long each (``2p+1`` left, ``2p`` right), the two
    sorted runs merge in a primitive sort with rights first on equal
    positions; a right's index in the merge counts what precedes it, rights
    among them, whose own number is r(r-1)/2."""
    merged = F.sort_array(F.concat(F.transform(left, lambda a: a * 2 + 1), F.transform(right, lambda b: b * 2)))
    zero = F.lit(0).cast("long")
    places = F.transform(merged, lambda e, i: F.when(e % 2 == 0, i.cast("long")).otherwise(zero))
    r = F.size(right).cast("long")
    return F.aggregate(places, zero, lambda acc, x: acc + x) - (r * (r - 1) / 2).cast("long")


def _clear(gram: Column) -> Column:
    """Lookup form of a gram: lower case, without negation marks."""
    return F.lower(F.replace(gram, F.lit(T.NEG_SUFFIX), F.lit("")))


def pair_scores(docs: DataFrame, items: Column, pair_lexicon: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A4 with ``use_pair``: the nine values of :func:`lexicon_scores` over
    ordered pairs ``g1---g2`` of grams, where the gram chain is all bigrams (in
    order) followed by all unigrams of the (possibly ``_NEG``-marked) tokens.
    A pair with a mark on either side is negated and flips the sign.

    Pairs are never enumerated: each (document, lexicon pair) counts its
    position pairs from the sorted positions of its two grams, once for all
    and once for the unmarked ones.  A lexicon of proven size comes to the
    documents, which stay where they are; any other is joined.
    """
    lex = (scored(pair_lexicon).join(pair_lexicon.select("term", "left", "right"), "term")
           .where(F.col("score").isNotNull()).select("left", "right", "score"))
    held = scoring.pair_scores(docs, items, lex, id_col)
    return held if held is not None else _pairs_by_join(docs, items, lex, id_col)


def _pairs_by_join(docs: DataFrame, items: Column, lex: DataFrame, id_col: str) -> DataFrame:
    """:func:`pair_scores` with ``lex(left, right, score)`` of any size: grams
    on either side of it are grouped per (document, gram) into sorted chain
    positions, and lists meet by a merge.  The last occurrence of a pair is
    the greatest right position with the greatest left one below it."""
    by_left = sized_broadcast(lex.select(F.col("left").alias("g"), "right", "score"))
    sides = sized_broadcast(lex.select(F.explode(F.array("left", "right")).alias("g")).distinct())
    base = docs.select(id_col, items.alias("_t"))
    marked = lambda g: F.contains(g, F.lit(T.NEG_SUFFIX)).cast("long")
    # A unigram's chain position follows all bigrams, which are only built when
    # some side of the lexicon is one.  A gram's place in the chain and its
    # mark travel as one long (2 * position + mark).
    shift = F.greatest(F.size("_t") - 1, F.lit(0))
    grams = base.select(id_col, shift.alias("_s"), F.posexplode("_t").alias("_p", "_g")).select(
        id_col, "_g", (F.col("_p") + F.col("_s")).alias("c"))
    if sides.where(F.col("g").contains(" ")).limit(1).count():
        grams = grams.unionByName(base.select(id_col, F.posexplode(T.ngrams(F.col("_t"), 2)).alias("c", "_g")))
    occ = (grams.select(id_col, _clear(F.col("_g")).alias("g"), (F.col("c") * 2 + marked(F.col("_g"))).alias("e"))
               .join(sides, "g", "left_semi")
               .groupBy(id_col, "g").agg(F.sort_array(F.collect_list("e")).alias("es"), F.max(F.col("e") % 2).alias("any")))
    lefts = occ.join(by_left, "g").select(id_col, "right", "score", F.col("es").alias("le"), F.col("any").alias("la"))
    rights = occ.select(id_col, F.col("g").alias("right"), F.col("es").alias("re"), F.col("any").alias("ra"))
    place = lambda es: F.transform(es, lambda e: F.shiftright(e, 1))
    plain = lambda es: place(F.filter(es, lambda e: e % 2 == 0))
    both = lefts.join(rights, [id_col, "right"]).select(
        id_col, "score", "le", F.element_at("re", -1).alias("r1"), _count_before(place("le"), place("re")).alias("n"),
        F.when(F.greatest("la", "ra") > 0, _count_before(plain("le"), plain("re"))).alias("_plain"))
    both = both.withColumn("n_plain", F.coalesce("_plain", "n"))
    below = F.zip_with("le", F.array_repeat("r1", F.size("le")),
                       lambda x, r: F.when(F.shiftright(x, 1) < F.shiftright(r, 1), x))
    pairs = both.where(F.col("n") > 0).select(id_col, "score", "n_plain", (F.col("n") - F.col("n_plain")).alias("n_neg"),
                                              F.struct(F.array_max(below).alias("l"), F.col("r1").alias("r")).alias("last"))
    s, up, down = F.col("score"), F.col("n_plain"), F.col("n_neg")
    n_for = lambda side: F.sum(F.when(side * s > 0, up).when(side * s < 0, down).otherwise(0))
    most = lambda side: F.max(F.when(((side * s > 0) & (up > 0)) | ((side * s < 0) & (down > 0)), F.abs(s)))
    total = lambda side: F.sum(F.when(side * s > 0, up).when(side * s < 0, down).otherwise(0) * F.abs(s))
    agg = pairs.groupBy(id_col).agg(
        n_for(1).alias("n_pos"), n_for(-1).alias("n_neg"), total(1).alias("sum_pos"), total(-1).alias("sum_neg"),
        most(1).alias("max_pos"), most(-1).alias("max_neg"),
        F.max_by(F.abs(s), F.when(s != 0, F.col("last"))).alias("last_nonzero"))
    # The chain's last pair is that of the last two tokens.
    end = F.slice("_t", -2, 2)
    tail = base.select(id_col, F.when(F.size("_t") > 1, end).alias("_e"))
    tail = tail.select(id_col, _clear(F.col("_e")[0]).alias("left"), _clear(F.col("_e")[1]).alias("right"),
                       F.exists("_e", lambda w: w.contains(T.NEG_SUFFIX)).alias("_neg"))
    final = tail.join(sized_broadcast(lex), ["left", "right"], "left").select(
        id_col, F.when(F.col("_neg"), -s).otherwise(s).alias("last_score"))
    out = final.join(agg, id_col, "left")
    long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    real = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 6)
    return out.select(id_col, long("n_pos"), long("n_neg"), real("sum_pos").alias("sum_pos"), real("sum_neg").alias("sum_neg"),
                      F.round(F.coalesce("sum_pos", F.lit(0.0)) - F.coalesce("sum_neg", F.lit(0.0)), 6).alias("net"),
                      *[real(c).alias(c) for c in ("max_pos", "max_neg", "last_nonzero", "last_score")])


def project_lexicon(docs: DataFrame, toks: Column, lexicon: DataFrame, value_col: str = "cls",
                    id_col: str = "doc_id", case_sensitive: bool = True, not_found: str | None = None,
                    out_col: str = "projected") -> DataFrame:
    """Replace each token by its lexicon class (or cluster).

    ``not_found=None`` keeps unknown tokens (P17); a string replaces them (P16,
    which also lower-cases tokens).  Documents are not shuffled while the
    lexicon fits a broadcast (:func:`lookup_tokens`).  A null token array
    gives an empty string.
    """
    keys = toks if case_sensitive else F.transform(toks, lambda w: F.lower(w))
    table = lexicon.select(F.col("term").alias("key"), F.col(value_col).cast("string").alias("value"))
    found = lookup_tokens(docs, keys, table, id_col, fallback=toks if not_found is None else None)
    return found.select(id_col, F.array_join("found", " ", not_found).alias(out_col))


def label_words(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """W4 word table ``(_key, _lab)``; a word in both sets is positive (the
    reference checks the positive set first)."""
    return (positives.select(F.col("term").alias("_key"), F.lit(1).alias("_rank"), F.lit("positives").alias("_lab"))
            .unionByName(negatives.select(F.col("term").alias("_key"), F.lit(2).alias("_rank"), F.lit("negatives").alias("_lab")))
            .groupBy("_key").agg(F.min_by("_lab", "_rank").alias("_lab")))


def distant_label(docs: DataFrame, toks: Column, positives: DataFrame, negatives: DataFrame,
                  id_col: str = "doc_id", words: DataFrame | None = None) -> DataFrame:
    """Label a document by the first token found in either word set;
    documents without a hit are dropped.  ``words`` may pass a prepared
    (already size-checked) :func:`label_words` table."""
    if words is None:
        words = sized_broadcast(label_words(positives, negatives))
    ex = docs.select(id_col, F.posexplode(toks).alias("_pos", "_key")).join(words, "_key")
    return ex.groupBy(id_col).agg(F.min_by("_lab", "_pos").alias("label"), F.min("_pos").cast("long").alias("first_pos"))


PIECE = 1_000  # terms


def invert(lexicon: DataFrame, size: int = PIECE) -> DataFrame:
    """Class -> members in numbered pieces ``(cls, piece, terms,
    n_terms)`` of at most ``size`` terms, sorted within and over the pieces.

    Places come from one global order, so a class that holds a third of the
    lexicon is many rows of many tasks; piece ``p`` starts at place ``p *
    size``.  A null term is no member."""
    g = global_index(lexicon.where(F.col("term").isNotNull()).select("cls", "term"), [F.col("cls"), F.col("term")], "_g")
    first = sized_broadcast(g.groupBy("cls").agg(F.min("_g").alias("_first")).withColumnRenamed("cls", "_c"))
    placed = g.join(first, F.col("cls").eqNullSafe(F.col("_c")))
    piece = F.floor((F.col("_g") - F.col("_first")) / F.lit(size)).cast("long")
    return placed.groupBy("cls", piece.alias("piece")).agg(F.array_sort(F.collect_list("term")).alias("terms"), F.count("*").alias("n_terms"))


def class_graph(lexicon: DataFrame) -> DataFrame:
    """A3: word -> neighbours = all words of its class (itself included).

    The graph is kept in implicit form ``(term, cls, degree)``: a word's
    neighbour set is its class's member list (:func:`invert`), so the
    |class|^2 edge table is never materialised (a class may hold a third of
    the vocabulary).  Consumers join on ``cls`` or aggregate per class."""
    deg = lexicon.groupBy("cls").agg(F.count(F.lit(1)).alias("degree"))
    return lexicon.select("term", "cls").join(sized_broadcast(deg), "cls").select("term", "cls", "degree")


def union_last_wins(*lexicons: DataFrame) -> DataFrame:
    """Merge lexicons by priority, later ones override earlier ones."""
    parts = [lx.select("term", "cls", F.lit(i).alias("_prio")) for i, lx in enumerate(lexicons)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("term").agg(F.max_by("cls", "_prio").alias("cls"))


def single_words(lexicon: DataFrame) -> DataFrame:
    """Keep single-token lexicon terms."""
    return lexicon.where(F.size(F.split("term", " ")) == 1)
