"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id in joins and orders: nulls sort first and count as one id.
NULL_ID = -(2**63)
BITS = 1 << 24
#: MB of its own that a Python worker may keep between two tasks.
KEPT_MB = 90
#: What workers keep from task to task, by operator.
CACHES: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="varicomp-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the rows of an Arrow batch, of which a task holds a few copies; texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name: mapInArrow itself refuses names with a dot. Batches are read by position."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(giving_back(run), schema)


def own_mb() -> float:
    """MB of this process that it shares with no file."""
    with open("/proc/self/statm") as f:
        size = f.read().split()
    return (int(size[1]) - int(size[2])) * os.sysconf("SC_PAGE_SIZE") / 1e6


def give_back() -> None:
    """Returns freed memory to the system, which Arrow's pool and malloc would keep, if it is worth the while."""
    try:
        if own_mb() > KEPT_MB:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another system than Linux with glibc
        pass


def drop_caches(keeps: str = "") -> None:
    """Empties the caches of all operators but one."""
    for name, cache in CACHES.items():
        if name != keeps:
            cache.clear()


def giving_back(run, keeps: str = ""):
    """For mapInArrow: run, after which its worker, which other tasks use, holds no freed memory; caches only of the operator keeps.

    Idle workers stay beside those at work and the executor's heap, at the size of the largest task that they ever had.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(keeps)
        yield from run(batches)
        give_back()

    return task


def chained(*runs):
    """The functions one after another as one, for one mapInArrow: batches stay in one Python worker, where a mapInArrow each
    would hold a worker each in every task and send all batches through the JVM between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for each in runs:
            batches = each(batches)
        return batches

    return run


def bitmap(keys: DataFrame) -> np.ndarray:
    """Marks each of keys (column key, long), and few others: a bitmap of BITS bits, whatever their number."""
    at = F.pmod(F.col("key"), F.lit(BITS)) + 1  # Spark counts bits from 1
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    found = np.zeros(BITS, bool)
    for bucket, bits in maps.collect():  # at most BITS / 32,768 rows of 4 KB
        some = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
        found[(bucket - 1) * 32_768 + some] = True
    return np.packbits(found)


def where_marked(bits: np.ndarray, key: str, marked: bool = True):
    """For mapInArrow: the rows whose key a bitmap marks, or those it doesn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(batch.schema.get_field_index(key)).to_numpy() % BITS
            yield batch.filter(pa.array(((bits[k >> 3] >> (7 - (k & 7))) & 1 == 1) == marked))

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the n + 1 offsets into it; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def id_key(column: str):
    """The id as long, nulls as NULL_ID."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))
