"""Topics as folders of JSON lines: a message is one text column, data. Publishing is an atomic append; nothing is trimmed. A consumer group is a checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the two topics and of their consumer groups.
INTAKE, EXTRACTION = "queue:ingestion", "queue:extraction"
GROUPS = {INTAKE: "processing-group", EXTRACTION: "output-group"}


class Topics:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def folder(self, topic: str) -> str:
        return f"{self.root}/{topic.replace(':', '_')}"

    def publish(self, messages: DataFrame, topic: str, batch: str | None = None) -> None:
        """Appends; with a batch name, which a replay repeats, writes over what that batch has written before."""
        rows = messages.select(F.to_json(F.struct(*messages.columns), {"ignoreNullFields": "false"}).alias("value"))
        if batch is None:
            rows.write.mode("append").text(self.folder(topic))
        else:
            rows.write.mode("overwrite").text(f"{self.folder(topic)}/batch={batch}")

    def subscribe(self, topic: str, schema: T.StructType, files: int = 100) -> DataFrame:
        """From the earliest message on; a micro-batch reads up to so many files."""
        self._make(topic)
        lines = self.spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).text(self.folder(topic))
        return lines.select(F.from_json("value", schema).alias("m")).select("m.*")

    def read(self, topic: str, schema: T.StructType) -> DataFrame:
        self._make(topic)
        lines = self.spark.read.option("recursiveFileLookup", True).text(self.folder(topic))
        return lines.select(F.from_json("value", schema).alias("m")).select("m.*")

    def checkpoint(self, topic: str) -> str:
        return f"{self.root}/_groups/{GROUPS.get(topic, topic).replace(':', '_')}"

    def _make(self, topic: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder(topic))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
