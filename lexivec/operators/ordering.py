"""Global order positions without a single-task window.

``Window.orderBy`` with no partition moves every row into one task.  Here the
frame is range-partitioned and sorted by Spark, materialised with a reliable
checkpoint (so a retried task sees the same order), and each row gets
``partition offset + position in partition``; the offsets come from a table
with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.session import checkpointed, ensure_checkpoint_dir


def global_index(df: DataFrame, order: list, name: str = "idx", start: int = 1) -> DataFrame:
    """Add ``name`` = position of the row in the total order ``order``.

    ``order`` must be a total order (include a unique tie-breaker).
    """
    ensure_checkpoint_dir(df.sparkSession)
    ck = checkpointed(df.sort(*order))
    ck = ck.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    sizes = ck.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    out = ck.join(F.broadcast(offs), "_pid").withColumn(name, F.col("_off") + local + F.lit(start))
    return out.drop("_pid", "_mid", "_off")


def average_rank(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Average-tie rank (1-based) of ``value`` over the whole frame.

    ``key`` is a unique row key used as tie-breaker for the global order; tied
    values get the mean of their positions.
    """
    idx = global_index(df.select(key, value), [F.col(value), F.col(key)], "_i")
    spans = idx.groupBy(value).agg(((F.min("_i") + F.max("_i")) / 2.0).alias(name))
    return df.join(idx.select(key, value), [key, value]).join(spans, value)


def hash_order(key: Column, seed: str = "42") -> Column:
    """Engine-neutral pseudo-random order key: ``md5(key || seed)``."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


HEX_DIGITS = 4  # of a hash that one counting pass parts: 65,536 counts
FEW_ROWS = 10_000  # that are left for a top-k


def order_cut(df: DataFrame, key: str, n: int, seed: str = "42") -> tuple | None:
    """``(hash, key)`` of the ``n``-th row in hash order (ties by key), None
    where all rows come before it or ``n`` is not positive.

    Radix selection: rows are counted by the next four hex digits of the hash,
    the range that holds the place is counted by the four after those, and so
    on until few rows are left for a top-k.  Nothing is sorted; the driver
    sees 65,536 counts a pass at most.
    """
    if n <= 0:
        return None
    rows = df.select(F.coalesce(hash_order(F.col(key), seed), F.lit("")).alias("h"), F.col(key).alias("k"))
    prefix, before = "", 0
    while len(prefix) < 32:
        counts = rows.groupBy(F.substring("h", len(prefix) + 1, HEX_DIGITS).alias("d")).count().orderBy("d").collect()
        if not prefix and sum(c["count"] for c in counts) <= n:
            return None
        for c in counts:
            if before + c["count"] >= n:
                break
            before += c["count"]
        digits, size = c["d"], c["count"]
        rows = rows.where(F.substring("h", len(prefix) + 1, HEX_DIGITS) == digits)
        prefix += digits
        if size <= FEW_ROWS or not digits:
            break
    if not digits:  # rows without a key
        return "", None
    if size > FEW_ROWS:  # one hash: its rows share a key
        found = rows.first()
    else:
        found = rows.orderBy("h", "k").limit(n - before).collect()[-1]
    return found["h"], found["k"]


def successors(df: DataFrame, group: str, key: str, steps: list[int]) -> DataFrame:
    """For each row, the ``key`` of the rows ``s`` places later in its group
    (ordered by ``key``), for each ``s`` in ``steps`` (null past the end).

    Same result as ``lead(key, s) over (partition by group order by key)``,
    but skew-safe: positions come from one global order and successors are
    found by an equi-join on (group, position + s), which spreads a huge group
    over all tasks instead of sorting it inside one.
    """
    g = global_index(df.select(group, key), [F.col(group), F.col(key)], "_i")
    out = g
    for s in steps:
        nxt = g.select(F.col(group), (F.col("_i") - s).alias("_i"), F.col(key).alias(f"{key}_{s}"))
        out = out.join(nxt, [group, "_i"], "left")
    return out.drop("_i")
