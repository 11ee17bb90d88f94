"""What the operators share: staged tables, packed blobs, Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import ctypes
import io
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the contracts: a run of characters other than the six ASCII white-space characters. ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def smallest(df: DataFrame, n: int, *names: str) -> DataFrame:
    """A bounded sample: the n rows with the smallest 64-bit hashes of the named columns, all rows if there are no more. Each task keeps n rows
    at most, so neither the number of rows nor repeats of one row matter."""
    return df.orderBy(F.xxhash64(*names), *names).limit(n)


def quoted(name: str) -> str:
    """A column's name that may hold dots."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (local tests) a temporary one is made."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="inkspan-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/inkspan/{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already; the folder is then left to its owner
            pass

    atexit.register(drop)
    return path


def stage(df: DataFrame, packed: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, survives lost executors, and
    forgets the partitioning, so that joins above it exchange both sides and adaptive execution can split hot keys.
    packed: its bytes are compressed already."""
    spark = df.sparkSession
    path = _new_path(spark)
    df.write.option("compression", "uncompressed" if packed else "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def discard(*staged: DataFrame | None) -> None:
    """Deletes what stage() wrote, once nothing that is still to run reads it. Other DataFrames, and a table that is named twice, are left alone."""
    for df in staged:
        path = df.__dict__.pop("_staged_at", None) if df is not None else None
        if path:
            _delete(df.sparkSession, path)


def stage_bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As stage(), in so many buckets by key: a later cogroup by that key reads it in place, without a shuffle."""
    spark = df.sparkSession
    name = "inkspan_" + uuid.uuid4().hex
    path = _new_path(spark)
    df.write.option("compression", "uncompressed").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return spark.read.table(name)


def partitions_for(df: DataFrame, per_partition: int) -> int:
    """How many partitions of per_partition input bytes the optimiser's size estimate of df asks for; the session's number of
    shuffle partitions where it has none (rows that come from Python, say, count as 8 EB)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 58:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(100_000, max(8, -(-size // per_partition))))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts can be long: Arrow batches get at most so many rows. The session keeps the setting, since the plan that needs it runs later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def copy_rows(batch: pa.RecordBatch, start: int, end: int) -> pa.RecordBatch:
    """A slice in memory of its own: a plain one keeps the whole batch alive, columns left out included."""
    return batch.take(pa.array(np.arange(start, end)))


def give_back() -> None:
    """Freed memory to the system: Python workers stay for the next task, and several may wait beside one at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(step: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A step over a task's batches that gives memory back at its end."""

    @wraps(step)
    def run(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(*args, **kwargs)
        finally:
            give_back()

    return run


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_table(table: pa.Table) -> bytes:
    """An Arrow stream whose buffers are compressed."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as w:
        w.write_table(table)
    return out.getvalue()


def unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as compressed differences, byte plane by byte plane."""
    deltas = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return squeeze(np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def chunk_id() -> int:
    """A new id for what one task has gathered; ids are fixed once the table that holds them is staged."""
    return uuid.uuid4().int >> 65

