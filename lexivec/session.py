"""Session construction and cluster-safe helpers (checkpointing, sized broadcast)."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Broadcast limits: a side is only broadcast when a bounded scan proves it small,
# in rows and in (estimated payload) bytes.
DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 256 << 20


def build_session(master: str | None = None, app: str = "lexivec",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session tuned for the library's jobs.

    AQE re-plans joins at runtime (coalescing small shuffles, splitting skewed
    partitions); Arrow is enabled for the few pandas-backed operators.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    # On a cluster, partitions and memory are the cluster's settings.
    cpus = os.environ.get("BENCH_CPUS")
    parts = shuffle_partitions or (int(cpus) if cpus else 8 if is_local(master) else None)
    if parts:
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    if is_local(master):
        b = b.config("spark.driver.memory", "8g")
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str | None) -> bool:
    """Whether the master runs all tasks in the driver's process."""
    return bool(master) and master.split("[")[0] == "local"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system folder and is used as
    is.  Where it is unset, a local master (tests) gets a fresh folder; any
    other raises, as executors would not see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not is_local(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="lexivec-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


#: Of a cached table, to a checkpoint file where few files are asked for.
FILE_BYTES = 8 << 20


def checkpointed(df: DataFrame, few: bool = False) -> DataFrame:
    """Reliable checkpoint of ``df`` into the shared checkpoint folder,
    computing ``df`` once.

    ``checkpoint()`` writes the files in a second job that recomputes the
    plan unless it is persisted; persisting first lets that write read the
    cached blocks.  The cache is dropped afterwards: the result reads the
    checkpoint files, so a lost executor costs a re-read, not a recompute.

    ``few``: for tables that shuffles read, a file for each ``FILE_BYTES``, or
    as many as the cluster runs tasks, instead of one for each partition.  On
    a local file system without Hadoop's native library every file starts a
    process that sets its permissions, and until that process runs its own
    program it counts as a second executor's memory.
    """
    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = (held.coalesce(_files(held)) if few else held).checkpoint(eager=True)
    held.unpersist()
    return out


def _files(held: DataFrame) -> int:
    held.count()  # fills the cache; its size is known from then on
    size = int(str(held.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(held.sparkSession.sparkContext.defaultParallelism, min(-(-size // FILE_BYTES), 1 << 20))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared checkpoint folder:
    computed once, lineage cut, later reads take the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _row_bytes(df: DataFrame) -> Column:
    """Cheap per-row payload estimate from the schema: string/binary octets,
    8 bytes per numeric array element or scalar, JSON length for other nested
    values, plus 16 bytes of row overhead."""
    def nn(c):
        return F.coalesce(c, F.lit(0))
    total = F.lit(16)
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.StringType, T.BinaryType)):
            total = total + nn(F.octet_length(c))
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.NumericType, T.BooleanType)):
            total = total + nn(F.size(c)) * 8
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            total = total + nn(F.octet_length(F.to_json(c)))
        else:
            total = total + 8
    return total


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                    max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it provably has at most ``max_rows`` rows and
    about ``max_bytes`` bytes of payload.

    One bounded job over ``limit(max_rows + 1)`` counts the rows and sums a
    per-row size estimate, so it never scans more than ``max_rows + 1`` rows.
    Above either bound the plain DataFrame is returned and Spark shuffles
    both join sides (AQE may still pick a broadcast at runtime from real
    shuffle sizes).
    """
    head = df.limit(max_rows + 1)
    n, size = head.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def bounded_arrow(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES):
    """``df`` as an Arrow table if it provably has at most ``max_rows`` rows
    and about ``max_bytes`` bytes of payload, else None (nothing but the two
    numbers reaches the driver then)."""
    head = df.limit(max_rows + 1)
    n, size = head.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return head.toArrow().combine_chunks() if n <= max_rows and size <= max_bytes else None


def in_slices(batches: Iterator[pa.RecordBatch], lists: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose lists (column ``lists``) hold about
    ``most`` items together, or of one row.  Without rows there is none."""
    for b in batches:
        sizes = pc.fill_null(pc.list_value_length(b.column(lists)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def round6(c):
    """Round a double column to 6 decimals (engine-neutral float comparison)."""
    return F.round(c.cast("double"), 6)
