"""Candidate groups in blocks of bounded size.

Similarity joins meet in buckets, and one bucket may hold a third of all rows.
:func:`block_pairs` cuts each bucket into blocks of about ``size`` members and
deals every pair of blocks to its own group, so that a bucket's work spreads
over all tasks and a group holds at most two blocks.  No pair is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import shuffle_parts
from lexivec.session import checkpointed


def in_blocks(members: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """``members`` of buckets with two members or more, with ``_blocks`` (of
    the bucket) and ``_block`` (own one, by ``member``)."""
    # The sizes are written out: both sides of the join are then plain shuffles, which Spark can split where a key is hot.
    sizes = checkpointed(members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    own = members.join(sizes, key).withColumn("_blocks", F.ceil(F.col("_n") / size).cast("long")).drop("_n")
    return own.withColumn("_block", F.pmod(F.xxhash64(member), F.col("_blocks")))


def paired(own: DataFrame, key: str) -> DataFrame:
    """:func:`in_blocks` dealt to pairs of blocks ``_i <= _j``: partitioned by
    (key, _i, _j) and sorted by it."""
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other"))
    by = [key, "_i", "_j"]
    return dealt.drop("_blocks", "_other").repartition(shuffle_parts(own), *by).sortWithinPartitions(*by)


def block_pairs(members: DataFrame, key: str, member: str, size: int) -> DataFrame:
    return paired(in_blocks(members, key, member, size), key)


def groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``by``: tables of whole groups and the index of
    each row's group.  A table has about ``rows`` rows, or one group."""
    held: list[pa.RecordBatch] = []
    n = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for name in by:
            c = t.column(name).combine_chunks()
            if isinstance(c, pa.ChunkedArray):
                c = pa.concat_arrays(c.chunks)
            new[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False), bool)
        return new

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        new = starts(t)
        last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
        if last:
            yield t.slice(0, last), np.cumsum(new[:last]) - 1
        rest = t.slice(last).combine_chunks()
        held, n = rest.to_batches(), 0 if rest.num_rows < rows else n - last
        n = rest.num_rows
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.cumsum(starts(t)) - 1
