"""Retrofitting word vectors to lexicons (R1, R2, R4), synchronous updates.

R1 uses the class-sum identity: with Jacobi updates the class sum is
invariant, so every word iterates on its own against one precomputed sum
(one aggregation, no neighbour join).  R2 couples classes through their sums,
which follow a recurrence over one row per class.  R4 joins the synonym
graph once per iteration; lineage is cut with reliable checkpoints.
All keep whole arrays and sum them with a partial vector aggregate, so huge
classes are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from lexivec.session import checkpointed, ensure_checkpoint_dir, sized_broadcast


def retrofit_class_vectors(vectors: DataFrame, lexicon: DataFrame, a: float = 0.5, b: float = 0.5, n_iter: int = 10) -> DataFrame:
    """``q <- (n a q0 + b (S - q)) / (n (a + b))`` for each lexicon word
    with ``n = |class| - 1 > 0`` in-vocabulary class neighbours; ``S`` is the
    class sum of the original vectors (invariant).  Others keep their vector.
    Output ``(word, vec)``; words without a vector are left out.

    A class's sum is one partial vector per task before any shuffle, so a
    class that holds a third of the words is as cheap as another; words meet
    their class's row by a join of proven size, else AQE's skew join."""
    v = vectors.where("vec IS NOT NULL").select("word", F.col("vec").cast("array<double>").alias("vec"))
    held = v.join(lexicon.select(F.col("term").alias("word"), "cls"), "word", "left")
    stats = held.where("cls IS NOT NULL").groupBy("cls").agg(
        vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("S"), (F.count(F.lit(1)) - 1).alias("n"))
    n = F.col("n").cast("double")

    def moved(v0, s):
        q = v0
        for _ in range(n_iter):
            q = (n * a * v0 + (s - q) * b) / (n * (a + b))
        return q

    found = held.join(sized_broadcast(stats), "cls", "left")
    return found.select("word", F.when(n > 0, F.zip_with("vec", "S", moved)).otherwise(F.col("vec")).alias("vec"))


def retrofit_class(vectors: DataFrame, lexicon: DataFrame, a: float = 0.5, b: float = 0.5,
                   n_iter: int = 10, digits: int | None = 6) -> DataFrame:
    """:func:`retrofit_class_vectors` as long rows ``(word, dim, value)``."""
    out = retrofit_class_vectors(vectors, lexicon, a, b, n_iter).select("word", F.posexplode("vec").alias("dim", "value"))
    val = F.round("value", digits) if digits is not None else F.col("value")
    return out.select("word", F.col("dim").cast("long").alias("dim"), val.alias("value"))


def _class_path(v0: np.ndarray, n: np.ndarray, totals: list[np.ndarray], a: float, b: float, c: float) -> tuple[np.ndarray, np.ndarray]:
    """Class sums after ``len(totals)`` steps of :func:`retrofit_repel`, and
    what those steps add to each member besides a multiple of its own vector.
    ``v0``: original class sums, ``n``: members less one, ``totals``: the sum
    of all classes before each step."""
    s, added = v0.copy(), np.zeros_like(v0)
    live = (n > 0)[:, None]
    scale = np.where(n > 0, n * (a + b), 1.0)[:, None]
    for t in totals:
        pull = (b * s - c * (t - s)) / scale
        added = np.where(live, pull - b / scale * added, 0.0)
        # All n + 1 members are pulled alike; of their own vectors each gives back b / scale.
        s = np.where(live, n[:, None] * a * v0 / scale + (n[:, None] + 1) * pull - b / scale * s, s)
    return s, added


def retrofit_repel(vectors: DataFrame, lexicon: DataFrame, a: float = 1.0, b: float = 1.0, c: float = 1.0,
                   n_iter: int = 10) -> DataFrame:
    """R2: R1 minus ``c`` times the sum of the other classes' words:
    ``q <- (n a q0 + b (S_c - q) - c (T - S_c)) / (n (a + b))``; n = 0 keeps the
    vector.  Only lexicon words take part.  Output long ``(word, dim, value)``.

    The class sums ``S_c`` follow a recurrence of their own, so the iterations
    run over one row per class; each sends the driver the total ``T``, a single
    vector.  A word's vector is then ``alpha_c q0 + G_c``, made in one pass."""
    lex = lexicon.select(F.col("term").alias("word"), "cls")
    members = vectors.select("word", "vec").join(lex, "word")
    sums = members.groupBy("cls").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("v0"), (F.count(F.lit(1)) - 1).cast("double").alias("n"))
    sums = checkpointed(sums)  # one row per class
    totals: list[np.ndarray] = []

    def path(batches: Iterator[pa.RecordBatch], upto: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column(2).to_numpy()
                yield batch, n, *_class_path(np.stack(batch.column(1).to_numpy(zero_copy_only=False)), n, upto, a, b, c)

    for _ in range(n_iter):
        upto = list(totals)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [s.sum(axis=0) for _, _, s, _ in path(batches, upto)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0)], pa.list_(pa.float64()))], names=["t"])

        parts = sums.select("cls", "v0", "n").mapInArrow(partial, "t array<double>")
        total = parts.groupBy(F.lit("all")).agg(vector_to_array(Summarizer.sum(array_to_vector("t"))).alias("t")).first()
        if total is None:  # no class
            break
        totals.append(np.array(total["t"]))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, _, added in path(batches, totals):
            back = np.where(n > 0, -b / np.where(n > 0, n * (a + b), 1.0), 0.0)
            alpha = np.ones(len(n))
            for _ in totals:
                alpha = np.where(n > 0, a / (a + b) + back * alpha, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(alpha), pa.array(list(added), pa.list_(pa.float64()))], names=["cls", "alpha", "added"])

    kind = lexicon.schema["cls"].dataType.simpleString()
    moved = sums.select("cls", "v0", "n").mapInArrow(steps, f"cls {kind}, alpha double, added array<double>")
    done = members.join(sized_broadcast(moved), "cls").select("word", F.zip_with("vec", "added", lambda v, g: F.col("alpha") * v + g).alias("q"))
    return done.select("word", F.posexplode("q").alias("dim", "q")).select("word", F.col("dim").cast("long").alias("dim"), F.round("q", 6).alias("value"))


def retrofit_graph(vectors: DataFrame, edges: DataFrame, n_iter: int = 10, checkpoint_every: int = 3) -> DataFrame:
    """R4 (Faruqui et al. 2015), synchronous form:
    ``q_i <- (n_i q0_i + sum_{j in N(i)} q_j) / (2 n_i)`` with N(i) the distinct
    in-vocabulary neighbours of ``i``; words without neighbours keep q0.

    Vectors stay whole arrays (one row per word, not per dimension).  The
    neighbour sum is Spark ML's ``Summarizer`` sum, a partial aggregate: each
    map task combines its edges per source word before the shuffle, so a hub
    word receives one partial vector per task, whatever its degree.
    Output long ``(word, dim, value)``."""
    vocab = vectors.select(F.col("word"))
    e = (edges.select("src", "dst").distinct()
         .join(vocab.withColumnRenamed("word", "src"), "src", "left_semi")
         .join(vocab.withColumnRenamed("word", "dst"), "dst", "left_semi"))
    # the filtered graph is reused by every iteration: materialise it once
    e = checkpointed(e)
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("src", "word")
    cur = vectors.select("word", F.col("vec").alias("v0")).join(deg, "word", "left").withColumn("q", F.col("v0"))
    n = F.col("n")
    for it in range(n_iter):
        nb = (e.join(cur.select(F.col("word").alias("dst"), array_to_vector("q").alias("qv")), "dst")
               .groupBy("src").agg(Summarizer.sum(F.col("qv")).alias("s"))
               .select(F.col("src").alias("word"), vector_to_array("s").alias("nsum")))
        step = F.zip_with("v0", "nsum", lambda x, y: (n * x + y) / (2.0 * n))
        cur = cur.join(nb, "word", "left").select("word", "n", "v0", F.when(n > 0, step).otherwise(F.col("v0")).alias("q"))
        if (it + 1) % checkpoint_every == 0:
            cur = checkpointed(cur)
    out = cur.select("word", F.posexplode("q").alias("dim", "q"))
    return out.select("word", F.col("dim").cast("long").alias("dim"), F.round("q", 6).alias("value"))


def _class_sums(cur: DataFrame) -> DataFrame:
    """``(cls, S)``: the sum of ``q`` per class, a partial aggregate of whole vectors."""
    sums = cur.where(F.col("cls").isNotNull()).groupBy("cls").agg(Summarizer.sum(array_to_vector("q")).alias("S"))
    return sums.select("cls", vector_to_array("S").alias("S"))


def retrofit_spill(vectors: DataFrame, lexicon: DataFrame, neighbours: DataFrame, a: float = 0.5, b: float = 0.5,
                   d: float = 1.0, n_iter: int = 10, checkpoint_every: int = 2) -> DataFrame:
    """Every iteration makes one class step (R1), then each lexicon word
    ``i`` with ``n_i > 0`` pushes an update to its neighbours ``k`` in the
    original vectors (``neighbours(query, word)`` from kNN):
    ``q_k <- d (d n_i a q0_k + b (S_c(i) - q_i))`` with the sums and vectors
    after the class step; no denominator.  Updates are synchronous; when
    several words update the same ``k`` the largest word wins (an explicit
    order for "last writer wins").  Words outside the lexicon change by spill
    only.  Output long ``(word, dim, value)``."""
    lex = lexicon.select(F.col("term").alias("word"), "cls").join(vectors.select("word"), "word", "left_semi")
    sizes = sized_broadcast(lex.groupBy("cls").agg((F.count(F.lit(1)) - 1).alias("n")))
    sized = lex.join(sizes, "cls")
    winner = checkpointed(neighbours.select("query", F.col("word").alias("k"))
                          .join(sized.where(F.col("n") > 0).select(F.col("word").alias("query")), "query", "left_semi")
                          .groupBy("k").agg(F.max("query").alias("query")))
    cur = vectors.select("word", F.col("vec").alias("v0")).join(sized, "word", "left").withColumn("q", F.col("v0"))
    n = F.col("n")
    rest = F.zip_with("S", "q", lambda s, q: s - q)
    for it in range(n_iter):
        pulled = F.zip_with("v0", rest, lambda v, x: (n * a * v + b * x) / (n * (a + b)))
        cur = cur.join(_class_sums(cur), "cls", "left").select(
            "word", "cls", "n", "v0", F.when(n > 0, pulled).otherwise(F.col("q")).alias("q"))
        push = (winner.join(cur.select(F.col("word").alias("query"), "cls", F.col("n").alias("m"), "q"), "query")
                      .join(_class_sums(cur), "cls").select(F.col("k").alias("word"), "m", rest.alias("x")))
        spilt = F.zip_with("v0", "x", lambda v, x: d * (d * F.col("m") * a * v + b * x))
        cur = cur.join(push, "word", "left").select(
            "word", "cls", "n", "v0", F.when(F.col("m").isNotNull(), spilt).otherwise(F.col("q")).alias("q"))
        if (it + 1) % checkpoint_every == 0:
            cur = checkpointed(cur)
    out = cur.select("word", F.posexplode("q").alias("dim", "q"))
    return out.select("word", F.col("dim").cast("long").alias("dim"), F.round("q", 6).alias("value"))
