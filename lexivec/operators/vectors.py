"""Word-vector operators: normalisation, cosine, exact k-nearest neighbours,
closest-in-lexicon scores and ranks, mean vectors.

Similarity search runs in :mod:`lexivec.operators.similarity`: both sides stay
distributed and meet in pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.operators import similarity
from lexivec.operators.similarity import QUERY_BLOCK, ROW_BLOCK
from lexivec.session import DEFAULT_BROADCAST_ROWS, bounded_arrow


def l2_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(vec: Column, eps: float = 0.0) -> Column:
    """``v / sqrt(sum(v^2) + eps)``; a zero vector stays zero.
    The norm is an argument of ``zip_with`` (computed once per row)."""
    v = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) + F.lit(eps))
    safe = F.when(norm > 0, norm).otherwise(F.lit(1.0))
    return F.zip_with(v, F.array_repeat(safe, F.size(v)), lambda x, n: x / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """V1: cosine similarity of two array columns."""
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def knn(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, exclude_col: str | None = None,
        row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top-k neighbours ``(query, word, rank, sim)``.

    ``vectors(word, vec)`` is the searched vocabulary, ``queries(word, vec[,
    exclude])`` are the asked vectors, both of any size; ``exclude_col`` names
    an array of words never returned for that query (analogy inputs).  Ties
    are broken by word; rank is 1-based.
    """
    return similarity.top_k(vectors, queries, k, exclude_self, exclude_col, row_block, query_block)


def closest_class_scores(vectors: DataFrame, lexicon: DataFrame, words: DataFrame | None = None,
                         row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Per word and class, the max cosine to any class member in the
    vocabulary (a member scores 1.0 with itself).  Output ``(word, cls, score)``.
    ``words`` may name the words to score: those outside the vocabulary get -1
    for every class.  A lexicon without a word in the vocabulary gives no rows
    for the words inside it."""
    mem = lexicon.join(vectors.select(F.col("word").alias("term"), "vec"), "term").select(F.col("term").alias("word"), "cls", "vec")
    asked = vectors if words is None else vectors.join(words.select("word").distinct(), "word", "left_semi")
    out = similarity.class_maxima(asked, mem, row_block, query_block)
    if words is None:
        return out
    unknown = words.select("word").distinct().join(vectors.select("word"), "word", "left_anti")
    none = similarity.with_pieces(unknown, mem, "cls").select("word", "cls", F.lit(-1.0).alias("score"))
    return out.unionByName(none)


def closest_class_ranks(neighbours: DataFrame, lexicon: DataFrame, topn: int, words: DataFrame) -> DataFrame:
    """For each word and class, ``(rank-1)/topn`` of the closest top-n
    neighbour in that class (D8 fixed: first hit), default 2.0 when the class
    has no word among the neighbours.  ``neighbours`` comes from :func:`knn`."""
    hits = (neighbours.join(lexicon.select(F.col("term").alias("word"), "cls"), "word")
            .groupBy("query", "cls").agg(F.min("rank").alias("r")))
    grid = similarity.with_pieces(words.select(F.col("word").alias("query")), lexicon, "cls")
    out = grid.join(hits, ["query", "cls"], "left")
    return out.select(F.col("query").alias("word"), "cls",
                      F.coalesce((F.col("r") - 1) / F.lit(float(topn)), F.lit(2.0)).alias("rank_score"))


def mean_vectors(df: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """A5: per-dimension mean per group, long format ``(group, dim, value)``.
    Partial aggregation per (group, dim) keeps a huge group spread over tasks."""
    ex = df.select(group, F.posexplode(vec).alias("dim", "x"))
    return ex.groupBy(group, "dim").agg(F.avg("x").alias("value"))


BATCH_VALUES = 1 << 20  # of concatenated vectors in a batch, but for a document that has more


def doc_vectors(docs: DataFrame, toks: Column, vectors: DataFrame, dim: int, id_col: str = "doc_id", max_words: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Concatenate the vectors of lower-cased tokens (zeros when missing),
    in token order.  Output ``(id, vec)``; no tokens, or null, give an empty
    array.  ``vectors(word, vec)`` has a word once and ``dim`` values a vector;
    null words and vectors are none.

    A proven small vector table comes to the documents, which stay in place.
    Above that bound each document's distinct words, with their places, are
    joined to their vectors (hot words are cut by AQE's skew join), so that a
    vector moves once for a word of a document, and no text moves; there
    ``id`` names a document."""
    kind = docs.schema[id_col].dataType.simpleString()
    low = F.transform(F.coalesce(toks, F.array().cast("array<string>")), lambda w: F.lower(w))
    asked = docs.select(F.col(id_col).alias("id"), low.alias("_t"))
    vectors = vectors.where("word IS NOT NULL AND vec IS NOT NULL").select("word", F.col("vec").cast("array<double>").alias("vec"))
    small = bounded_arrow(vectors, max_words)
    if small is None:
        return _doc_vectors_by_join(asked, vectors, dim, id_col, kind)
    words = pa.concat_arrays(small["word"].chunks) if small.num_rows else pa.array([], pa.string())
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in small["vec"].chunks]
    table = np.concatenate([*values, np.zeros(dim)]).reshape(-1, dim)
    held = docs.sparkSession.sparkContext.broadcast((words, table))

    def run(batches):
        keys, table = held.value
        for b in batches:
            sizes = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            at = 0
            while at < b.num_rows:
                upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]) * dim, BATCH_VALUES, "right")))
                piece = b.slice(at, upto - at)
                places = pc.fill_null(pc.index_in(piece.column(1).flatten(), value_set=keys), len(table) - 1).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(sizes[at:upto])]) * dim
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(table[places].ravel()))], [id_col, "vec"])
                at = upto

    return asked.mapInArrow(run, f"`{id_col}` {kind}, vec array<double>")


def _doc_vectors_by_join(asked: DataFrame, vectors: DataFrame, dim: int, id_col: str, kind: str) -> DataFrame:
    words = asked.mapInArrow(_word_places, f"id {kind}, n int, word string, places array<int>")
    met = words.join(vectors, "word", "left")
    cell = F.when(F.col("vec").isNotNull(), F.struct("places", "vec"))
    found = met.groupBy("id").agg(F.max("n").alias("n"), F.collect_list(cell).alias("cells"))

    def lay(batches):
        for b in batches:
            for row in b.to_pylist():
                out = np.zeros((row["n"], dim))
                for c in row["cells"]:
                    out[c["places"]] = c["vec"]
                yield pa.RecordBatch.from_arrays([pa.array([row["id"]], b.column(0).type), pa.array([out.ravel()], pa.list_(pa.float64()))], [id_col, "vec"])

    return found.mapInArrow(lay, f"`{id_col}` {kind}, vec array<double>")


def _word_places(batches):
    """A row for each distinct word of a document, with its places; one
    without a word where there is none."""
    for b in batches:
        ids, ns, words, places = [], [], [], []
        for i, toks in enumerate(b.column(1).to_pylist()):
            where: dict = {}
            for place, word in enumerate(toks):
                where.setdefault(word, []).append(place)
            for word, at in (where or {None: []}).items():
                ids.append(i), ns.append(len(toks)), words.append(word), places.append(at)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), pa.array(ns, pa.int32()), pa.array(words, pa.string()), pa.array(places, pa.list_(pa.int32()))], ["id", "n", "word", "places"])


def to_long(df: DataFrame, key: str, vec: str = "vec", digits: int = 6) -> DataFrame:
    """Vectors in long format ``(key, dim, value)`` rounded for comparison."""
    return df.select(key, F.posexplode(vec).alias("dim", "value")).select(
        key, F.col("dim").cast("long").alias("dim"), F.round("value", digits).alias("value"))


def analogy_queries(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Query vector ``b - a + c`` over unit vectors (normalised), with
    ``a, b, c`` excluded from the answers.  ``questions(qid, section[,
    section_no], a, b, c, d)``; questions with a word outside the vocabulary
    are dropped."""
    u = vectors.select("word", l2_normalize(F.col("vec")).alias("u"))
    j = questions
    for w in ("a", "b", "c"):
        j = j.join(u.select(F.col("word").alias(w), F.col("u").alias(f"u{w}")), w)
    v = F.zip_with(F.zip_with("ub", "ua", lambda x, y: x - y), F.col("uc"), lambda x, y: x + y)
    number = F.col("section_no").cast("long") if "section_no" in questions.columns else F.lit(None).cast("long")
    return j.select(F.col("qid").alias("word"), "section", number.alias("section_no"), "d", l2_normalize(v).alias("vec"),
                    F.array("a", "b", "c").alias("exclude"))


def analogy_accuracy(questions: DataFrame, vectors: DataFrame, semantic_sections: int = 5) -> DataFrame:
    """Top-1 answer of every question; accuracy per section and
    whether the section is semantic (one of the first ``semantic_sections``
    with a question left, by ``section_no``, their order in the file) or
    syntactic.  Without that column sections go by name."""
    q = analogy_queries(questions, vectors)
    top = knn(vectors, q.select("word", "vec", "exclude"), 1, exclude_self=False, exclude_col="exclude")
    res = q.select(F.col("word").alias("query"), "section", "section_no", "d").join(top.select("query", F.col("word").alias("answer")),
                                                                                     "query", "left")
    per = res.groupBy("section").agg(F.count(F.lit(1)).alias("n_questions"), F.min("section_no").alias("section_no"),
                                     F.sum((F.col("answer") == F.col("d")).cast("int")).alias("n_correct"))
    from lexivec.operators.ordering import global_index
    per = global_index(per, [F.col("section_no").asc_nulls_last(), F.col("section")], "_no")
    return per.select("section", F.when(F.col("_no") <= semantic_sections, "semantic").otherwise("syntactic").alias("kind"),
                      F.col("n_questions").cast("long").alias("n_questions"),
                      F.coalesce(F.col("n_correct"), F.lit(0)).cast("long").alias("n_correct"),
                      F.round(F.coalesce(F.col("n_correct"), F.lit(0)) / F.col("n_questions"), 6).alias("accuracy"))
