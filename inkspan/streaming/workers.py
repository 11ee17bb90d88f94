"""The two workers as streaming queries. Each micro-batch runs a stage of the batch pipeline and writes its results under the batch's number, so a replayed batch writes
over itself: delivery is at least once, the effect once."""

from __future__ import annotations

import logging
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators.jobs import reclaim, requeue, snapshot
from inkspan.plans.pipeline import ATTEMPT, Settings, event, finish, ingest, messages_of, process
from inkspan.schemas import EXTRACTED, INGESTED, JOB_EVENT
from inkspan.sources.files import Objects, dataset
from inkspan.sources.staging import drop, keep_in
from inkspan.streaming.topics import EXTRACTION, INTAKE, Topics

#: Fixed value: up to so many rows of a dataset are taken in while the caller waits.
INLINE = 5
_log = logging.getLogger(__name__)


class Service:
    """Everything below one root: objects, topics, the log of job events and the outputs."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self.topics, self.objects = Topics(spark, f"{self.root}/topics"), Objects(spark, f"{self.root}/objects")
        self._behind: threading.Thread | None = None

    def _log(self, events: DataFrame, name: str) -> None:
        events.write.mode("overwrite").parquet(f"{self.root}/job_events/batch={name}")

    def events(self) -> DataFrame:
        return self.spark.read.schema(JOB_EVENT).option("recursiveFileLookup", True).parquet(f"{self.root}/job_events")

    def jobs(self) -> DataFrame:
        return snapshot(self.events())

    def submit(self, uploads: DataFrame, tenant_id: str, name: str) -> DataFrame:
        """Takes documents in: objects, then events, then messages, so that no consumer sees a job that is not there. Returns the rejected ones."""
        accepted, queued, rejected = ingest(uploads, tenant_id, F.current_timestamp(), self.settings.bucket)
        self.objects.put_all(accepted.select(F.col("input_file_path").alias("path"), "content"))
        self._log(queued, f"submit-{name}")
        self.topics.publish(messages_of(accepted), INTAKE, f"submit-{name}")
        return rejected

    def submit_dataset(self, folder: str, tenant_id: str, name: str, split: str = "test", limit: int | None = None) -> int:
        """Takes a dataset's split in. Up to INLINE rows are taken in now, and their number is returned; more are by a thread of their own, and 0 is."""
        rows = dataset(self.spark, folder, split, limit).select(F.concat("id", F.lit(".png")).alias("filename"), F.col("image").alias("content"), "ground_truth")
        if limit is not None and limit <= INLINE:
            self.submit(rows, tenant_id, name)
            return rows.count()
        self._behind = threading.Thread(target=self.submit, args=(rows, tenant_id, name))
        self._behind.start()
        return 0

    def wait(self) -> None:
        """Until what was begun by submit_dataset() is done."""
        if self._behind:
            self._behind.join()

    def _process(self, batch: DataFrame, number: int) -> None:
        held, place = batch.persist(), f"{self.root}/intermediate/process-{number}"
        try:
            done = process(held, self.objects.with_content, F.current_timestamp(), keep_in(place), self.settings)
            self.objects.put_all(done["objects"])
            self._log(done["events"], f"process-{number}")
            self.topics.publish(done["again"], INTAKE, f"again-{number}")
            self.topics.publish(done["next"], EXTRACTION, f"process-{number}")
        finally:
            held.unpersist()
        drop(self.spark, place)

    def _finish(self, batch: DataFrame, number: int) -> None:
        held, place = batch.dropDuplicates(["job_id", "retry_count"]).persist(), f"{self.root}/intermediate/finish-{number}"
        try:
            # only the batch's own jobs are put together from the log
            current = snapshot(self.events().join(held.select("job_id").distinct(), "job_id", "left_semi"))
            done = finish(held, current, F.current_timestamp(), keep_in(place))
            paths = done["output"].select(F.concat_ws("/", F.lit(self.settings.bucket), "key").alias("path"), F.col("final_output").cast("binary").alias("content"))
            self.objects.put_all(paths)
            self._log(done["events"], f"finish-{number}")
            self.topics.publish(done["again"], EXTRACTION, f"again-{number}")
            self._tidy_up(done["output"])
        finally:
            held.unpersist()
        drop(self.spark, place)

    def _tidy_up(self, ended: DataFrame) -> None:
        """What was read and extracted for jobs that have their final output goes; input and final output stay. A failure is told, and stops nothing."""
        try:
            each = ended.withColumn("name", F.explode(F.array(F.lit("ocr_output.json"), F.lit("extraction.json"))))
            self.objects.delete_all(each.select(F.concat_ws("/", F.lit(self.settings.bucket), "tenant_id", "job_id", "name").alias("path")))
        except Exception as error:  # noqa: BLE001
            _log.warning("intermediate objects stay: %s", error)

    def start(self, topic: str, once: bool = False):
        """The worker of a topic as a running query; once: until everything there has been read."""
        schema, step = (INGESTED, self._process) if topic == INTAKE else (EXTRACTED, self._finish)
        writer = self.topics.subscribe(topic, schema).writeStream.foreachBatch(step).option("checkpointLocation", self.topics.checkpoint(topic))
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()

    def drain(self, rounds: int = 1) -> None:
        """Both workers over what is there."""
        for _ in range(rounds):
            for topic in (INTAKE, EXTRACTION):
                self.start(topic, once=True).awaitTermination()

    def outputs(self) -> DataFrame:
        """(job_id, final_output): of every job that has one."""
        found = self.objects.listing(self.settings.bucket).where(F.col("path").endswith("/final_output.json"))
        return found.select(F.element_at(F.split("path", "/"), -2).alias("job_id"), F.col("content").cast("string").alias("final_output"))

    def reap(self, name: str, idle_seconds: int = 300) -> int:
        """One pass of the reaper: messages of jobs whose consumer fell silent are delivered again, their retry_count one higher; those out of retries fail. How
        many were found."""
        now = F.current_timestamp()
        found = reclaim(self.jobs(), now, idle_seconds).persist()
        try:
            number, status = F.col("retry_count") * ATTEMPT + 91, F.when(F.col("failed"), "failed").otherwise(F.col("status"))
            self._log(found.select(*event(F.col("job_id"), number, now, status, retry_count=F.col("retry_count"), error_message=F.when(F.col("failed"), "Failed: no consumer answered"))), f"reap-{name}")
            self.topics.publish(found.where("not failed").select("job_id", "tenant_id", "input_file_path", "retry_count"), INTAKE, f"reap-{name}")
            return found.count()
        finally:
            found.unpersist()

    def run(self, stop: threading.Event, reap_every: float = 30, idle_seconds: int = 300, back_off: float = 1.0) -> None:
        """Both workers and the reaper until stop is set. A worker that ended with an error begins again after a pause, from its checkpoint."""
        running, last, passes = {}, time.monotonic(), 0
        try:
            while not stop.is_set():
                for topic in (INTAKE, EXTRACTION):
                    if topic not in running or not running[topic].isActive:
                        if topic in running:
                            _log.warning("the worker of %s begins again: %s", topic, running[topic].exception())
                            stop.wait(back_off)
                        running[topic] = self.start(topic)
                if time.monotonic() - last >= reap_every:
                    last, passes = time.monotonic(), passes + 1
                    self.reap(f"{uuid.uuid4().hex[:8]}-{passes}", idle_seconds)
                stop.wait(0.2)
        finally:
            for query in running.values():
                query.stop()

    def requeue(self, name: str) -> int:
        """Publishes a message for every queued job; how many. May repeat one that waits already; the job's events then repeat too, without effect."""
        waiting = requeue(self.jobs())
        self.topics.publish(waiting, INTAKE, f"requeue-{name}")
        return waiting.count()
