"""Pictures, ground-truth texts and objects in folders of any file system that Spark reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what counts as a picture in a benchmark's folder.
PICTURES = "*.{jpg,png,jpeg}"


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("file_name", F.substring_index("path", "/", -1)).withColumn("stem", F.regexp_replace("file_name", r"\.[^.]*$", ""))


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, stem, content): the folder's pictures as bytes."""
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", PICTURES).load(folder)).select("path", "file_name", "stem", "content")


def decoded(spark: SparkSession, folder: str, drop_invalid: bool = True) -> DataFrame:
    """The folder's pictures decoded by the JVM, blue first: (origin, height, width, nChannels, mode, data)."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(folder).select("image.*")


def truths(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, truth): whole text files."""
    read = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select("value", F.input_file_name().alias("path"))
    return _named(read).select("stem", F.col("value").alias("truth"))


def with_truths(images: DataFrame, texts: DataFrame) -> DataFrame:
    """An empty truth where there is no file."""
    return images.join(texts, "stem", "left").withColumn("truth", F.coalesce("truth", F.lit("")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds _n: the row's number from 0, files in the order of their names, rows in that of their file. How many rows stand in the files before is a sum over
    one row a file."""
    marked = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = marked.groupBy("_file").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.join(sizes.select("_file", before.alias("_before")), "_file").withColumn("_n", F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")


def dataset(spark: SparkSession, folder: str, split: str = "test", limit: int | None = None) -> DataFrame:
    """Rows of a dataset's split: image (bytes), id (its own, else hf_ and the row's number) and ground_truth (JSON text: what is JSON as it is, other text under raw,
    nothing as an empty object)."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be 1 or more")
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{split}")
    numbered = _numbered(rows)
    numbered = numbered.where(F.col("_n") < limit) if limit else numbered
    own = F.col("id").cast("string") if "id" in rows.columns else F.lit(None).cast("string")
    text = F.col("parsed_data").cast("string") if "parsed_data" in rows.columns else F.lit(None).cast("string")
    truth = F.when(text.isNull(), "{}").when(F.try_parse_json(text).isNotNull(), text).otherwise(F.to_json(F.struct(text.alias("raw"))))
    return numbered.select("image", F.coalesce(own, F.concat(F.lit("hf_"), F.col("_n").cast("string"))).alias("id"), truth.alias("ground_truth"))


def _file_system(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a root and the root's path in it, as executors see them."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return (arrow_fs.LocalFileSystem(), root) if root.startswith("/") else arrow_fs.FileSystem.from_uri(root)


def _put(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Each object is written beside its place and moved there, so that a reader never sees a part of one, and a task that runs again writes the same."""
    store, base = _file_system(root)
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            folder, _, name = f"{base}/{path}".rpartition("/")
            store.create_dir(folder, recursive=True)
            part = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(data.as_buffer() if data.is_valid else b"")
            store.move(part, f"{folder}/{name}")
        yield batch.select([0])


def _delete(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    store, base = _file_system(root)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            if store.get_file_info(f"{base}/{path}").type == arrow_fs.FileType.File:
                store.delete_file(f"{base}/{path}")
        yield batch.select([0])


def _read(batches: Iterator[pa.RecordBatch], root: str, at: int, each: int = 16) -> Iterator[pa.RecordBatch]:
    """The rows with their objects' bytes, few at a time; null where there is none."""
    store, base = _file_system(root)

    def content(path: str | None) -> bytes | None:
        try:
            with store.open_input_stream(f"{base}/{path}") as data:
                return data.read()
        except (FileNotFoundError, IsADirectoryError):
            return None

    for batch in batches:
        for start in range(0, batch.num_rows, each):
            some = batch.slice(start, each)
            found = [None if p is None else content(p) for p in some.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.binary())], names=[*some.schema.names, "content"])


class Objects:
    """Objects at bucket/key below a root. Many are written, read and deleted by the executors that hold their rows; single ones through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put_all(self, df: DataFrame) -> int:
        """df(path: bucket/key, content: binary): objects written over what was there; how many. Buckets are made as they are named."""
        return df.select("path", "content").mapInArrow(partial(_put, root=self.root), "path string").count()

    def delete_all(self, df: DataFrame) -> int:
        """df(path): nothing happens where there is none; how many were named."""
        return df.select("path").mapInArrow(partial(_delete, root=self.root), "path string").count()

    def with_content(self, df: DataFrame, path: str) -> DataFrame:
        """Adds content (binary): the object at the path, null where there is none. Only the rows' own objects are read; nothing is joined."""
        schema = T.StructType([*df.schema.fields, T.StructField("content", T.BinaryType())])
        return df.mapInArrow(partial(_read, root=self.root, at=df.columns.index(path)), schema)

    def _at(self, bucket: str, key: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{bucket}/{key}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, bucket: str, key: str, data: bytes) -> None:
        path, fs = self._at(bucket, key)
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, bucket: str, key: str) -> bytes:
        if not self.exists(bucket, key):
            raise FileNotFoundError(f"{bucket}/{key}")
        return bytes(self.spark.read.format("binaryFile").load(f"{self.root}/{bucket}/{key}").select("content").first()[0])

    def exists(self, bucket: str, key: str) -> bool:
        path, fs = self._at(bucket, key)
        return fs.exists(path)

    def delete(self, bucket: str, key: str) -> None:
        """Nothing happens where there is none."""
        path, fs = self._at(bucket, key)
        fs.delete(path, False)

    def listing(self, bucket: str) -> DataFrame:
        """(path, length, content) of all objects of a bucket; path begins with the bucket."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.root}/{bucket}")
        # every path begins with the root as the file system itself writes it
        path, fs = self._at(bucket, "")
        start = len(fs.makeQualified(path.getParent()).toString().rstrip("/")) + 2
        return found.select(F.substring("path", start, 1 << 30).alias("path"), "length", "content")
