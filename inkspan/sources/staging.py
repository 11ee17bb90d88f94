"""Results that several later plans read: written once and read again, so that engines do not run once for each reader."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Keep = Callable[[DataFrame, str], DataFrame]


def keep_in(folder: str) -> Keep:
    """folder: in a file system that the driver and all executors share."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return keep


def drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share; a temporary one only in a local session without that setting. It goes
    with the interpreter."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="inkspan-")
    path = f"{where.rstrip('/')}/inkspan-documents/{uuid.uuid4().hex}"

    def gone() -> None:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is then left to its owner
            pass

    atexit.register(gone)
    return path
