"""Similarity joins with both sides distributed.

Both sides are packed once into numbered blocks of bounded size, in the shared
checkpoint folder; a task reads one block of the side that it answers for and
all blocks of the other, one after another, or of a part of it where there are
fewer blocks than tasks.  So nothing is copied through an exchange for a pair
of blocks, a task holds two blocks, and nothing passes through the driver.  A
task folds what it reads into one running top-k (or one maximum a class) before
it sends anything on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.session import checkpointed

ROW_BLOCK, QUERY_BLOCK = 4_096, 8_192  # vectors; of 300 dimensions: 10 and 20 MB at most
LEAST_BLOCK = 256  # rows; smaller tables are cut finer, so that all tasks have work
TILE = 1_024  # queries multiplied at once: 16 MB of cosines
MOST_CLASSES = 1_024  # of which a task keeps maxima


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(_b, vec, lists...)`` as one row for each block: lists as they
    are, vectors as bytes, in single precision where that loses nothing."""
    for b in batches:
        if not b.num_rows:
            continue
        block, vecs = b.column(0).to_numpy(), b.column(1)
        m = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), -1)
        order = np.argsort(block, kind="stable")
        found, starts = np.unique(block[order], return_index=True)
        ends = [*starts[1:], len(order)]
        short = m.astype(np.float32)
        wide = not np.array_equal(short, m, equal_nan=True)
        data = [(m if wide else short)[order[lo:hi]].tobytes() for lo, hi in zip(starts, ends)]
        cuts = pa.array([*starts, len(order)], pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, c.take(pa.array(order))) for c in b.columns[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([wide] * len(found)), pa.array(data, pa.binary()), *lists], ["_b", "wide", "data", *b.schema.names[2:]])


def _matrix(data: list[bytes], wide: list[bool], n: int) -> np.ndarray:
    """Packed vectors as ``n`` rows of unit length; zero rows stay."""
    m = np.concatenate([np.frombuffer(d, np.float64 if w else np.float32).astype(np.float64) for d, w in zip(data, wide)]).reshape(n, -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1.0, length)


def _blocks(df: DataFrame, n: int, name: str = "word") -> DataFrame:
    """``df(word, vec, ...)`` in ``n`` blocks, a partition and a row each:
    ``(_b, data, wide, word, ...)``, where all but the number are arrays."""
    others = [c for c in df.columns if c != "vec"]
    kinds = ", ".join(f"`{c}` array<{df.schema[c].dataType.simpleString()}>" for c in others)
    rows = df.select(F.pmod(F.xxhash64(name), F.lit(n)).cast("int").alias("_b"), F.col("vec").cast("array<double>"), *others)
    pieces = rows.mapInArrow(_packed, f"_b int, wide boolean, data binary, {kinds}").repartitionById(n, F.col("_b"))
    # Not as Parquet: its reader holds many rows at once, and a row is a block.
    return checkpointed(pieces.mapInArrow(_joined, f"_b int, wide array<boolean>, data array<binary>, {kinds}"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a partition, one block's, as one row."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    whole = lambda c: pa.concat_arrays(t[c].chunks)
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    lists = [one(whole(c).flatten()) for c in t.column_names[3:]]
    yield pa.RecordBatch.from_arrays([pa.array([t["_b"][0].as_py()], pa.int32()), one(whole("wide")), one(whole("data")), *lists], t.column_names)


def block_pairs(streamed: DataFrame, own: DataFrame, streamed_block: int, own_block: int) -> tuple[DataFrame, bool]:
    """Every block of ``own`` with every block of ``streamed`` (columns with
    ``s_`` before them), and whether one task meets all pairs of an own block."""
    parts = _parts(own)
    n_streamed, n_own = streamed.count(), own.count()
    own_blocks = max(1, -(-n_own // own_block), min(parts, -(-n_own // LEAST_BLOCK)) if n_own <= own_block else 0)
    shares = -(-parts // own_blocks)
    blocks = max(1, -(-n_streamed // streamed_block), min(shares, -(-n_streamed // LEAST_BLOCK)))
    shares = min(shares, blocks)
    left = _blocks(streamed, blocks)
    left = left.select(*[F.col(c).alias(f"s_{c}") for c in left.columns]).coalesce(shares)
    return left.hint("shuffle_replicate_nl").crossJoin(_blocks(own, own_blocks)), shares == 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pairs of blocks, one by one."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: c[i] for name, c in zip(b.schema.names, b.columns)}


def _vectors(pair: dict, side: str) -> np.ndarray:
    return _matrix(pair[f"{side}data"].as_py(), pair[f"{side}wide"].as_py(), len(pair[f"{side}word"].values))


class TopK:
    """The k best rows so far of each of ``n`` queries."""

    def __init__(self, k: int, n: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self._query, self._sim, self._word = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, "U1")
        self._more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    query = property(lambda self: self._settled()._query)
    sim = property(lambda self: self._settled()._sim)
    word = property(lambda self: self._settled()._word)

    def passing(self, sims: np.ndarray, first: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries (from number ``first`` on) that may be among the
        best by ``sims`` (rows x queries), which are off by ``slack`` at most;
        -inf marks pairs left out."""
        floor = (self.floor[first : first + sims.shape[1]] - slack).astype(sims.dtype)
        over = sims >= floor
        # Once the floors have risen few rows pass them; until then each block's own k-th best is a higher one.
        if np.count_nonzero(over) > 2 * self.k * sims.shape[1]:
            spare = max(sims.shape[0] - self.k, 0)
            own = np.partition(sims, spare, axis=0)[spare]
            over = sims >= np.maximum(floor, (own - 2 * slack).astype(sims.dtype))
        r, c = np.nonzero(over)
        some = np.isfinite(sims[r, c])
        return r[some], c[some] + first

    def take(self, query: np.ndarray, sim: np.ndarray, word: np.ndarray) -> None:
        """Fold in pairs with their exact ``sim``."""
        self._more.append((query, sim, word))
        if not len(self._query) or sum(len(q) for q, _, _ in self._more) > len(self._query) // 4:
            self._settled()

    def add(self, sims: np.ndarray, words: np.ndarray, first: int) -> None:
        """Fold in exact ``sims`` (rows x queries from number ``first`` on).
        Ties go to the lesser word."""
        r, c = self.passing(sims, first)
        self.take(c, sims[r, c - first], words[r])

    def _settled(self) -> TopK:
        if not self._more:
            return self
        query, sim, word = (np.concatenate(x) for x in zip((self._query, self._sim, self._word), *self._more))
        self._more = []
        order = np.lexsort((-sim, query))
        q, s = query[order], sim[order]
        if ((q[1:] == q[:-1]) & (s[1:] == s[:-1])).any():
            order = np.lexsort((word, -sim, query))
            q = query[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = order[place < self.k]
        last = place == self.k - 1
        self.floor[q[last]] = sim[order[last]]
        self._query, self._sim, self._word = query[kept], sim[kept], word[kept]
        return self


def top_k(rows: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, exclude_col: str | None = None, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` rows of greatest cosine with each query: ``(query, word,
    rank, sim)``, ties by word.  ``rows(word, vec)``, ``queries(word, vec)``;
    ``exclude_col`` names an array of words that a query doesn't return.

    Products in single precision leave out the pairs that are too far below a
    query's k-th best; the others' cosines are made in double precision."""
    out = pa.schema([("query", pa.string()), ("word", pa.string()), ("rank", pa.int64()), ("sim", pa.float64())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            for at, top in zip(range(0, len(names), TILE), tops):
                query, word = top.query, top.word
                rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
                yield pa.RecordBatch.from_arrays([pa.array(names[at + query], pa.string()), pa.array(word.astype(object), pa.string()), pa.array(rank), pa.array(top.sim)], schema=out)

        block, tops = None, []
        for pair in _rows(batches):
            if pair["_b"].as_py() != block:
                yield from told() if tops else ()
                block, names = pair["_b"].as_py(), np.array(pair["word"].as_py(), object)
                order = np.argsort(names.astype(str), kind="stable")
                names = names[order]
                vecs = _vectors(pair, "")[order]
                short = vecs.astype(np.float32)
                tops = [TopK(k, min(TILE, len(names) - at)) for at in range(0, len(names), TILE)]
                slack = (vecs.shape[1] + 8) * 2.0**-23
                barred: dict[str, list[int]] = {}
                if exclude_self:
                    for i, w in enumerate(names):
                        barred.setdefault(w, []).append(i)
                if exclude_col:
                    given = pair[exclude_col].as_py()
                    for i, at in enumerate(order):
                        for w in given[at] or ():
                            barred.setdefault(w, []).append(i)
            words, v = pair["s_word"].as_py(), _vectors(pair, "s_")
            hits = [(i, j) for i, w in enumerate(words) for j in barred.get(w, ())]
            hr, hj = np.array(hits, np.int64).reshape(-1, 2).T
            words, low = np.array(words, str), v.astype(np.float32)
            for at, top in zip(range(0, len(names), TILE), tops):
                sims = low @ short[at : at + TILE].T
                here = (hj >= at) & (hj < at + TILE)
                sims[hr[here], hj[here] - at] = -np.inf
                r, c = top.passing(sims, 0, slack)
                if len(r):
                    top.take(c, np.einsum("ij,ij->i", v[r], vecs[at + c]), words[r])
        yield from told() if tops else ()

    asked = queries.select("word", "vec", *([exclude_col] if exclude_col else []))
    met, whole = block_pairs(rows.select("word", "vec"), asked, row_block, query_block)
    top = met.mapInArrow(best, "query string, word string, rank long, sim double")
    if not whole:
        w = Window.partitionBy("query").orderBy(F.col("sim").desc(), F.col("word"))
        top = top.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return top.select("query", "word", "rank", "sim")


def class_maxima(rows: DataFrame, members: DataFrame, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Greatest cosine of each row with a member of each class: ``(word, cls,
    score)``.  ``rows(word, vec)``, ``members(word, cls, vec)``."""
    out = pa.schema([("word", pa.string()), ("cls", pa.string()), ("score", pa.float64())])

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(place), pa.string())
            for at in range(0, len(v), TILE):
                here = best[at : at + TILE, : len(place)]
                r, c = np.nonzero(here != -np.inf)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(at + r)), names.take(pa.array(c)), pa.array(here[r, c])], schema=out)

        block, place = None, {}
        for pair in _rows(batches):
            if pair["_b"].as_py() != block:
                yield from told() if place else ()
                block, v, words = pair["_b"].as_py(), _vectors(pair, ""), pair["word"].values.cast(pa.string())
                place, best = {}, np.full((len(v), 16), -np.inf)
            cls = np.array(pair["s_cls"].as_py(), str)
            order = np.argsort(cls, kind="stable")
            names, starts = np.unique(cls[order], return_index=True)
            vecs = _vectors(pair, "s_")[order]
            for lo in range(0, len(names), MOST_CLASSES):
                some = names[lo : lo + MOST_CLASSES].tolist()
                if len(place) + sum(n not in place for n in some) > MOST_CLASSES:
                    yield from told()
                    place, best = {}, np.full((len(v), 16), -np.inf)
                to = [place.setdefault(n, len(place)) for n in some]
                if len(place) > best.shape[1]:
                    best = np.pad(best, ((0, 0), (0, max(len(place), 2 * best.shape[1]) - best.shape[1])), constant_values=-np.inf)
                first, own = starts[lo], starts[lo : lo + MOST_CLASSES]
                end = starts[lo + MOST_CLASSES] if lo + MOST_CLASSES < len(starts) else len(order)
                for at in range(0, len(v), TILE):
                    found = np.maximum.reduceat(v[at : at + TILE] @ vecs[first:end].T, own - first, axis=1)
                    best[at : at + TILE, to] = np.maximum(best[at : at + TILE, to], found)
        yield from told() if place else ()

    met, _ = block_pairs(members.select("word", "cls", "vec"), rows.select("word", "vec"), row_block, query_block)
    return met.mapInArrow(maxima, "word string, cls string, score double").groupBy("word", "cls").agg(F.max("score").alias("score"))


def with_pieces(df: DataFrame, values: DataFrame, value: str, piece: int = 1_000) -> DataFrame:
    """Every row of ``df`` with every distinct value of ``values``, met by the
    numbers of pieces of at most about ``piece`` values: an equi-join, and no
    row or task that holds all values."""
    distinct = values.select(value).distinct()
    n = -(-distinct.count() // piece)
    numbered = distinct.withColumn("_piece", F.pmod(F.xxhash64(value), F.lit(max(n, 1))).cast("int"))
    return df.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))).join(numbered, "_piece").drop("_piece")
