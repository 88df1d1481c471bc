"""Token lookups that leave documents where they are.

A document is one row, so replacing its tokens by a table's values needs no
shuffle while the table fits a broadcast: Arrow batches hold the tokens of many
documents in one flat array, which one vectorised lookup resolves.  Above the
bound tokens are exploded, joined and regrouped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.session import bounded_arrow

MAX_KEYS = 1_000_000


def lookup_tokens(docs: DataFrame, toks: Column, table: DataFrame, id_col: str = "doc_id",
                  fallback: Column | None = None, max_keys: int = MAX_KEYS) -> DataFrame:
    """``(id, found)``: for each token of an array, in order, its value in
    ``table(key, value)`` (keys unique), else the entry of ``fallback`` (a
    parallel array) at its place, else null.  A null array counts as empty."""
    head = bounded_arrow(table.select("key", "value").where(F.col("key").isNotNull()), max_keys)
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    asked = docs.select(id_col, listed(toks).alias("_t"), *[listed(c).alias("_f") for c in (fallback,) if c is not None])
    if head is None:
        return _lookup_by_join(asked, table, id_col)
    held = docs.sparkSession.sparkContext.broadcast(tuple(pa.concat_arrays(head[c].chunks) if head.num_rows else pa.array([], head.schema.field(c).type) for c in ("key", "value")))

    def found(batches):
        keys, values = held.value
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int32)
            hits = values.take(pc.index_in(lists.flatten(), value_set=keys))
            if batch.num_columns > 2:
                hits = pc.coalesce(hits, batch.column(2).flatten().cast(hits.type))
            offsets = pa.array(np.concatenate([np.zeros(1, np.int32), ends]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, hits)], [id_col, "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return asked.mapInArrow(found, f"`{id_col}` {kind}, found array<{table.schema['value'].dataType.simpleString()}>")


def _lookup_by_join(asked: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """The same by a shuffle join: only (id, position, token) rows move."""
    kept = "_f" in asked.columns
    cells = F.arrays_zip("_t", "_f") if kept else F.arrays_zip("_t")
    ex = asked.select(id_col, F.posexplode_outer(cells).alias("_pos", "_z")).select(id_col, "_pos", F.col("_z._t").alias("key"), "_z")
    value = F.coalesce(F.col("value"), F.col("_z._f")) if kept else F.col("value")
    cell = F.when(F.col("_pos").isNotNull(), F.struct("_pos", value.alias("value")))
    hit = ex.join(table.select("key", "value"), "key", "left").groupBy(id_col).agg(
        F.sort_array(F.collect_list(cell)).alias("_xs"))
    return hit.select(id_col, F.transform("_xs", lambda x: x["value"]).alias("found"))
