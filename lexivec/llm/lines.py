"""Substring dedup by hashing lines and their sentences.

A text's units are the sentences of its lines.  Each is normalised (A-Z
lower-cased, white space collapsed) and digested; digests are grouped over the
whole corpus; the occurrence of least rank (doc_id, then text hash, then unit)
stays, and all others repeat it.  Repeated units in a row, over line ends too,
make a run.  A passage may begin or end inside a sentence, so a run reaches on
into the units at its ends by the words they have in common with the units
beside the occurrence that stays.  Runs of ``LEAST_WORDS`` words go, so that a
stock phrase stays; the spans removed are kept as offsets in the source text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import batch, id_and_text, in_slices, packed, plain_key, text_hash, unpacked, words
from lexivec.session import checkpointed, sized_broadcast

LEAST_WORDS = 50  # of a run that is removed
LEAST_REACH = 3  # words of a unit beside a run; fewer in common are chance and stay
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20  # documents with runs beyond either meet the texts in a shuffle

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ENDS = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|\n")


def units(text: str) -> list[tuple[int, int, list[bytes]]]:
    """``(start, end, words)`` of each unit that has words: a unit ends with a
    line, or with a word that ends in ``.``, ``!`` or ``?``."""
    out, at = [], 0
    for m in _ENDS.finditer(text):
        if w := words(text[at : m.start()]):
            out.append((at, m.start(), w))
        at = m.end()
    if w := words(text[at:]):
        out.append((at, len(text), w))
    return out


_BYTE_ENDS = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|\n")


def _unit_words(text: str) -> list[list[bytes]]:
    """The words of each unit, as :func:`units` has them."""
    return [w for part in _BYTE_ENDS.split(text.encode("utf-8").lower()) if (w := part.split())]


def _form(w: list[bytes]) -> bytes:
    return b" ".join(w)


def _name(w: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(_form(w)) - (1 << 63)


def unit_digests(docs: DataFrame) -> DataFrame:
    """``key, text_hash, unit, n, before, after, d1, d2`` for each unit: its
    number, its words, those of its neighbours, its digest; no shuffle."""
    names = ["key", "text_hash", "unit", "n", "before", "after", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 500):
            sizes, digests, counts = [], [], []
            for text in b.column(2).to_pylist():
                found = _unit_words(text)
                counts.append(len(found))
                sizes += [0, *map(len, found), 0]
                digests += [xxhash.xxh3_128_digest(_form(w)) for w in found]
            counts = np.array(counts, np.int64)
            d = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            start = np.cumsum(counts) - counts
            unit = np.arange(len(d)) - np.repeat(start, counts)
            at = np.arange(len(d)) + np.repeat(2 * np.arange(len(counts)) + 1, counts)  # in sizes, which has a zero on either side of a text's
            sizes = np.array(sizes, np.int32)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(unit.astype(np.int32)), *[pa.array(sizes[at + k]) for k in (0, -1, 1)],
                                              pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))], names=names)

    return _texts(docs).mapInArrow(run, "key long, text_hash long, unit int, n int, before int, after int, d1 long, d2 long")


def _texts(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select(plain_key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("text_hash"), "text")


def runs(doc: np.ndarray, unit: np.ndarray, n: np.ndarray, before: np.ndarray, after: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated units that may reach ``least`` words with their
    neighbours, as ``(first, last, words, longest)``: indices of the run's
    first, last and longest (the first of equals) entry, and its words.
    Entries are sorted by document and unit."""
    if not len(unit):
        return (np.empty(0, np.int64),) * 4
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (unit[1:] != unit[:-1] + 1)])
    last = np.r_[first[1:], len(unit)] - 1
    n_words = np.add.reduceat(n.astype(np.int64), first)
    size = len(unit) + 1
    longest = size - 1 - np.maximum.reduceat(n.astype(np.int64) * size + (size - 1 - np.arange(len(unit))), first) % size
    keep = n_words + before[first] + after[last] >= least
    return first[keep], last[keep], n_words[keep], longest[keep]


def run_table(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``key, text_hash, first, last, words, s_key, s_hash, s_first`` for each
    run of units that repeat occurrences of lower rank."""
    found = unit_digests(docs).withColumn("rank", F.struct("key", "text_hash", "unit"))
    # A frequent unit meets as one row per task; both sides of the join are plain shuffles, which Spark can split where a unit is hot.
    first = checkpointed(found.groupBy("d1", "d2").agg(F.min("rank").alias("source"), F.max("rank").alias("last")).where("source <> last").select("d1", "d2", "source"))
    later = found.join(first, ["d1", "d2"]).where("rank <> source")
    per_doc = later.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set(F.struct("unit", "n", "before", "after", "source"))).alias("units"))  # at most a text's units
    names = ["key", "text_hash", "first", "last", "words", "s_key", "s_hash", "s_first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            cells = lists.flatten()
            unit, n, before, after = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("unit", "n", "before", "after"))
            s_key, s_hash, s_unit = (cells.field("source").field(c).to_numpy(zero_copy_only=False) for c in ("key", "text_hash", "unit"))
            first, last, n_words, longest = runs(doc, unit, n, before, after, least)
            own = pa.array(doc[first] if len(first) else np.empty(0, np.int64))
            # The source is where the longest unit first occurs, moved to the run's first unit.
            cols = [unit[first], unit[last], n_words.astype(np.int32), s_key[longest], s_hash[longest], s_unit[longest] - (unit[longest] - unit[first])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), *map(pa.array, cols)], names=names)

    return per_doc.mapInArrow(run, "key long, text_hash long, first int, last int, words int, s_key long, s_hash long, s_first int")


def _in_common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the common start of two lists, 0 if below ``LEAST_REACH``."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n if n >= LEAST_REACH else 0


def _beside(docs: DataFrame, at: DataFrame) -> DataFrame:
    """For ``at(key, text_hash, first, last)``, stretches of units in texts:
    the same and ``left, right`` (normal forms of the units beside, empty at a
    text's ends), ``head, tail`` (names of its first and last unit; null where
    the text has no such unit)."""
    out = pa.schema([("key", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("head", pa.int64()), ("tail", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 500):
            rows = []
            for key, h, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
                found = _unit_words(text)

                def form(k: int) -> bytes:
                    return _form(found[k]) if 0 <= k < len(found) else b""

                def name(k: int) -> int | None:
                    return _name(found[k]) if 0 <= k < len(found) else None

                rows += [(key, h, s["first"], s["last"], form(s["first"] - 1), form(s["last"] + 1), name(s["first"]), name(s["last"])) for s in wanted]
            yield batch(out, rows)

    per_doc = checkpointed(at.groupBy("key", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("wanted")))
    joined = _texts(docs).join(sized_broadcast(per_doc, BROADCAST_ROWS, BROADCAST_BYTES), ["key", "text_hash"])
    named = joined.mapInArrow(run, "key long, text_hash long, first int, last int, left binary, right binary, head long, tail long")
    return named.dropDuplicates(["key", "text_hash", "first", "last"])  # rows that agree in id and text


def spans_by_words(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``key, text_hash, runs``: for each document with something to remove
    the runs as ``first, last`` (units), ``before, after`` (words of the units
    beside that go as well)."""
    found = checkpointed(run_table(docs, least).withColumn("s_last", F.col("s_first") + F.col("last") - F.col("first")))
    own = _beside(docs, found.select("key", "text_hash", "first", "last"))
    source = _beside(docs, found.select(F.col("s_key").alias("key"), F.col("s_hash").alias("text_hash"), F.col("s_first").alias("first"), F.col("s_last").alias("last")))
    source = source.select(*[F.col(c).alias(f"s_{c}") for c in ("key", "first", "last", "left", "right", "head", "tail")], F.col("text_hash").alias("s_hash"))
    met = found.join(own, ["key", "text_hash", "first", "last"]).join(source, ["s_key", "s_hash", "s_first", "s_last"], "left")
    same = (F.col("key") == F.col("s_key")) & (F.col("text_hash") == F.col("s_hash"))
    # In one text, a run doesn't reach into the occurrence that stays, nor compare itself with itself.
    left = F.when(F.col("head").eqNullSafe(F.col("s_head")) & ~(same & (F.col("first") - 1 <= F.col("s_last"))), F.col("s_left"))
    right = F.when(F.col("tail").eqNullSafe(F.col("s_tail")) & ~(same & (F.col("s_last") + 1 >= F.col("first"))), F.col("s_right"))

    def reach(before: pa.Array, s_before: pa.Array, after: pa.Array, s_after: pa.Array) -> pa.Array:
        more = [[], []]
        for b, sb, a, sa in zip(*(c.to_pylist() for c in (before, s_before, after, s_after))):
            more[0].append(0 if sb is None else _in_common(b.split()[::-1], sb.split()[::-1]))
            more[1].append(0 if sa is None else _in_common(a.split(), sa.split()))
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in more], names=["before", "after"])

    grown = met.withColumn("more", _once(reach, "before int, after int")(F.col("left"), left, F.col("right"), right))
    grown = grown.where(F.col("words") + F.col("more.before") + F.col("more.after") >= least)
    return grown.groupBy("key", "text_hash").agg(F.sort_array(F.collect_set(F.struct("first", "last", "more.before", "more.after"))).alias("runs"))


def spans(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Spans that go for runs ``(first, last, words before, words after)``,
    sorted and apart.  Lines that go whole take their line feed with them
    (the one before, at the end of the text); others leave one gap."""
    own = units(text)
    out: list[list[int]] = []
    for first, last, before, after in found:
        a, b = own[first][0], own[last][1]
        if before:
            a = [m.start() for m in _WORD.finditer(text, *own[first - 1][:2])][-before]
        else:
            a = _WORD.search(text, a).start()
        if after:
            b = [m.end() for m in _WORD.finditer(text, *own[last + 1][:2])][after - 1]
        else:
            b = a + len(text[a:b].rstrip(_SPACE))
        if out and a <= _over_space(text, out[-1][1]):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [_with_gap(text, a, b) for a, b in out]


_SPACE = " \t\n\v\f\r"
_BLANK = " \t\v\f\r"


def _over_space(text: str, at: int) -> int:
    while at < len(text) and text[at] in _SPACE:
        at += 1
    return at


def _with_gap(text: str, a: int, b: int) -> tuple[int, int]:
    start, end = a, b
    while start and text[start - 1] in _BLANK:
        start -= 1
    while end < len(text) and text[end] in _BLANK:
        end += 1
    opens, closes = not start or text[start - 1] == "\n", end == len(text) or text[end] == "\n"
    if opens and closes:
        return (start, end + 1) if end < len(text) else (max(start - 1, 0), end)
    return (start, end) if closes else (a, end)


def cut(text: str, found: list[tuple[int, int]]) -> str:
    at, out = 0, []
    for a, b in found:
        out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated runs, and
    ``_removed``: their spans (start, end) in the original text, in code
    points.  Null text: stays null, nothing removed.

    Rows that agree in doc_id and text count as one document: what repeats an
    earlier document goes from each of them, and they don't repeat each other.
    Null ids rank last; rows of one id rank by a hash of the text.  A text is
    held whole in one task; equal units never are, however many.
    """
    keyed = packed(docs, plain_key(F.col("doc_id").cast("long")).alias("_key"), text_hash(F.col("text")).alias("_hash"))
    found = checkpointed(spans_by_words(docs, least).select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"), F.col("runs").alias("_runs")))
    joined = keyed.join(sized_broadcast(found, BROADCAST_ROWS, BROADCAST_BYTES), ["_key", "_hash"], "left").withColumn("_cut", _cutter()(F.col("_row.text"), F.col("_runs")))
    return unpacked(joined, docs.columns, {"text": F.coalesce(F.col("_cut.text"), F.col("_row.text"))}, F.coalesce("_cut.removed", F.array()).alias("_removed"))


_CUT = pa.struct([("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _cutter():
    """Arrow UDF (text, runs) -> (text, removed spans); null where nothing goes."""
    def removed(text: pa.Array, given: pa.Array) -> pa.Array:
        out: list[dict] = []
        for t, k in zip(text.to_pylist(), given.to_pylist()):
            gone = spans(t, [(r["first"], r["last"], r["before"], r["after"]) for r in k]) if t is not None and k is not None else []
            out.append({"text": cut(t, gone), "removed": [{"start": a, "end": b} for a, b in gone]} if gone else {"text": None, "removed": None})
        return pa.array(out, _CUT)

    return _once(removed, "struct<text: string, removed: array<struct<start: int, end: int>>>")


def _once(f, kind: str):
    """Arrow UDF that a filter on its result does not run a second time: Spark
    copies deterministic ones into the filter, and each copy is a worker more
    to a task."""
    return F.arrow_udf(f, kind).asNondeterministic()
