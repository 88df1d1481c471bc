"""Mixing sources to target weights by a low-discrepancy schedule.

Every slot of the mix is one block of equally many words.  Slot ``k`` gets the
point ``frac(k * golden ratio)``; the cumulative targets map the point to a
source, so that any stretch of the mix is near the targets.  Slots are ranked
within their source, and slot rank ``r`` takes block ``r`` of the source's
shuffled word stream, which repeats from its start when it is used up.

The points miss a source's number of slots by a few, which a small source
cannot bear: below ``SETTLED`` blocks a source gets evenly spread slots for
its target to the word, the last block cut to it.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import WORD, packed, plain_key, text_hash, unpacked
from lexivec.operators.ordering import global_index
from lexivec.session import checkpointed, sized_broadcast

BLOCK = 64  # words of a slot
SETTLED = 64  # blocks of a target; below, a source's words are settled exactly
LEAST_SLOTS = 4096  # smaller corpora get smaller blocks
MOST_REPEATS = 3
BUCKETS = 1024  # of a source's shuffled order, for sums without a task that holds a source
#: Fixed value: 2^31 times the golden ratio's fraction, to the nearest odd number; k times it mod 2^31 visits every point once.
GOLDEN = 1327217885
PERIOD = 2**31


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: ``source, source_no, source_size, weight, target``
    and ``upto`` (targets of the sources before it).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and
    share all words; what exceeds ``MOST_REPEATS`` times a source is shared
    again among the others by weight, until none is above.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = global_index(sums, [F.col("source").asc_nulls_last()], "source_no", 0)
    own = checkpointed(own.withColumn("weight", F.col("source_no") % 3 + 1))
    most = MOST_REPEATS * F.col("source_size")
    level, capped = 0.0, -1
    while True:  # the level only rises, and each round caps a source or is the last
        above = F.lit(level) * F.col("weight") > most
        r = own.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, most).otherwise(0)).alias("full"),
                    F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"), F.sum(above.cast("int")).alias("n")).first()
        if r["n"] == capped or not r["all"]:
            break
        capped, level = r["n"], (r["all"] - r["full"]) / r["open"]
    share = F.least(most.cast("double"), F.lit(level) * F.col("weight"))
    own = own.withColumn("target", share)
    # Sums over the order of sources, by their numbers: blocks of 1024 numbers, then the blocks.
    part = (F.col("source_no") / 1024).cast("long")
    inner = Window.partitionBy("_part").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_part", part)
    before = own.groupBy("_part").agg(F.sum("target").alias("_sum"))
    outer = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_part", F.coalesce(F.sum("_sum").over(outer), F.lit(0.0)).alias("_before"))
    own = own.withColumn("upto", F.coalesce(F.sum("target").over(inner), F.lit(0.0))).join(before, "_part")
    return checkpointed(own.select("source", "source_no", "source_size", "weight", "target", (F.col("upto") + F.col("_before")).alias("upto")))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each document with its place in its source's shuffled word stream, and
    the sources' targets.

    Columns: ``doc_id, source, text_hash, size, source_no, source_size,
    target, start``.  The order is that of md5(doc_id), ties by doc_id and a
    hash of the text: reruns agree.
    """
    sized = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_hash(F.col("text")).alias("text_hash"),
                                     n_words(F.col("text")).alias("size")))
    to = targets(sized)
    own = sized.join(sized_broadcast(to.select(F.col("source").alias("_s"), "source_no", "source_size", "target")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    own = own.withColumn("_order", order).withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 3), 16, 10).cast("int") * BUCKETS / 4096).cast("int"))
    sums = own.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_sum"))
    outer = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "_bucket", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("source_no", "_bucket").orderBy("_order", F.col("doc_id").asc_nulls_last(), "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["source_no", "_bucket"])
    out = own.select("doc_id", "source", "text_hash", "size", "source_no", "source_size", "target", (F.col("_before") + F.col("_within")).alias("start"))
    return checkpointed(out), to


def block_words(total: int) -> int:
    return max(1, min(BLOCK, total // LEAST_SLOTS))


def settled_words(block: int) -> Column:
    """A small source's target in whole words; null for the others."""
    return F.when(F.col("target") < SETTLED * block, F.floor(F.col("target") + 0.5).cast("long"))


def schedule(to: DataFrame) -> tuple[DataFrame, int]:
    """``slot, source_no, rank`` for every slot of the mix, and the words of a
    block.  ``rank`` counts a source's slots from 0.  A settled source's slots
    stand beside drawn ones, so they share numbers."""
    r = to.agg(F.sum("source_size").alias("all"), F.count(F.lit(1)).alias("n")).first()
    total = r["all"] or 0
    block = block_words(total)
    n = (total + block // 2) // block
    x = (F.col("id") % PERIOD) * GOLDEN % PERIOD
    cells = max(4096, r["n"])  # of [0, 1): a point meets only the sources that reach into its cell
    slots = to.sparkSession.range(n).select(F.col("id").alias("slot"), (x / PERIOD * total).alias("_at"))
    slots = slots.withColumn("_cell", F.floor(F.col("_at") / total * cells).cast("long") if total else F.lit(0).cast("long"))
    reach = [F.least(F.floor(c / F.lit(total or 1) * cells), F.lit(cells - 1)).cast("long") for c in (F.col("upto"), F.col("upto") + F.col("target"))]
    last = F.col("source_no") == r["n"] - 1  # sums of doubles may end a hair below the total
    words = settled_words(block)
    spans = to.where((F.col("target") > 0) & words.isNull()).select("source_no", F.col("upto").alias("_lo"), F.when(last, F.lit(float("inf"))).otherwise(F.col("upto") + F.col("target")).alias("_hi"),
                                          F.explode(F.sequence(reach[0], F.when(last, F.lit(cells - 1).cast("long")).otherwise(reach[1]))).alias("_cell"))
    drawn = slots.join(spans, "_cell").where("_at >= _lo and _at < _hi").select("slot", "source_no")
    # Ranks: within stretches of about the square root of all slots, then over the stretches.
    stretch = 1 << max(0, (max(n, 1).bit_length() + 1) // 2)
    drawn = drawn.withColumn("_part", F.floor(F.col("slot") / stretch).cast("long"))
    counts = drawn.groupBy("source_no", "_part").agg(F.count(F.lit(1)).alias("_n"))
    outer = Window.partitionBy("source_no").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "_part", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("source_no", "_part").orderBy("slot")
    ranked = drawn.withColumn("_r", F.row_number().over(inner) - 1).join(counts, ["source_no", "_part"])
    ranked = ranked.select("slot", "source_no", (F.col("_before") + F.col("_r")).alias("rank"))
    # Settled sources: spread evenly, each from a golden-ratio point of its own.
    small = to.select("source_no", words.alias("_words")).where("_words > 0").withColumn("_n", F.ceil(F.col("_words") / block))
    small = small.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    phase = (F.col("source_no") % PERIOD) * GOLDEN % PERIOD / PERIOD
    at = F.least(F.floor((F.col("rank") + phase) / F.col("_n") * n), F.lit(n - 1)).cast("long")
    return ranked.unionByName(small.select(at.alias("slot"), "source_no", "rank")), block


def mix(own: DataFrame, to: DataFrame) -> DataFrame:
    """The mix: for each slot the pieces of documents that its block holds.

    Columns: ``slot, source_no, start`` (the document, with ``source_no``),
    ``repeat`` (0 for the first time), ``first_word, n_words``.
    """
    slots, block = schedule(to)
    copies = own.where("size > 0").select("source_no", "source_size", "target", "start", "size", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1))).alias("repeat"))
    # A source gets its target's slots and a few more or less; later repeats are left out early.
    copies = copies.withColumn("_from", F.col("start") + F.col("repeat") * F.col("source_size")).where(F.col("_from") <= F.col("target") * 1.5 + 64 * block)
    copies = copies.withColumn("_upto", F.least(F.col("_from") + F.col("size"), settled_words(block))).where("_from < _upto")  # least() skips nulls
    number = F.sequence(F.floor(F.col("_from") / block).cast("long"), F.floor((F.col("_upto") - 1) / block).cast("long"))
    pieces = copies.withColumn("rank", F.explode(number))
    lo, hi = F.greatest("_from", F.col("rank") * block), F.least("_upto", (F.col("rank") + 1) * block)
    pieces = pieces.select("source_no", "rank", "start", "repeat", (lo - F.col("_from")).alias("first_word"), (hi - lo).alias("n_words"))
    return slots.join(pieces, ["source_no", "rank"]).select("slot", "source_no", "start", "repeat", "first_word", "n_words")


def taken(docs: DataFrame) -> DataFrame:
    """Each document with the words that the mix takes of it (repeats count).

    Columns: ``doc_id, source, text_hash, size, source_size, target, taken``.
    Null text: size 0.  Null source: a source of its own, last.  Repeated rows
    are documents of their own.  A table without words gives zeros.
    """
    own, to = placed(docs)
    sums = mix(own, to).groupBy("source_no", "start").agg(F.sum("n_words").alias("_taken"))
    out = own.join(sums, ["source_no", "start"], "left")
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a document that is
    taken whole k times stands there k times, and one whose words are taken in
    part stands there with that part (``n_chars``, if present, counts anew).

    Rows that agree in doc_id, source and text share evenly what is taken of
    them together (rounded down to words).
    """
    n = taken(docs).groupBy("doc_id", "source", "text_hash").agg(F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"), F.max("size").alias("_size")).where("_taken > 0")
    n = n.select(plain_key(F.col("doc_id")).alias("_key"), F.col("doc_id").isNull().alias("_no_id"), F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_no_source"),
                 F.col("text_hash").alias("_hash"), "_size", F.floor(F.col("_taken") / F.col("_rows")).alias("_each"))
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    here = packed(docs, plain_key(doc_id).alias("_key"), doc_id.isNull().alias("_no_id"), F.coalesce(source, F.lit("")).alias("_source"), source.isNull().alias("_no_source"), text_hash(F.col("text")).alias("_hash"))
    j = here.join(n, ["_key", "_no_id", "_source", "_no_source", "_hash"])
    whole, part = F.floor(F.col("_each") / F.col("_size")).cast("int"), (F.col("_each") % F.col("_size")).cast("int")
    takes = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))  # 0: whole
    j = j.withColumn("_take", F.explode(takes))
    some = F.slice(F.regexp_extract_all("_row.text", F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1)), 1, F.greatest("_take", F.lit(1)))
    text = F.when(F.col("_take") == 0, F.col("_row.text")).otherwise(F.rtrim(F.array_join(some, ""), F.lit(" \t\n\x0b\x0c\r")))
    j = j.withColumn("_text", text)
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_take") == 0, F.col("_row.n_chars")).otherwise(F.length("_text")).cast(dict(docs.dtypes)["n_chars"])
    return unpacked(j, docs.columns, changed)
