"""Jobs as an append-only log of events: snapshot, state machine, retries, re-queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.schemas import IN_FLIGHT, STATUSES, TENANT, TERMINAL, TRANSITIONS

MAX_RETRIES = 3
#: Kinds of error that a retry cannot mend.
PERSISTENT = ("persistent", "value", "key", "type")


def transitions(spark: SparkSession) -> DataFrame:
    """(from_status, to_status): every allowed change of a job's status."""
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_status string, to_status string")


def is_allowed(before: Column, after: Column) -> Column:
    """New jobs may begin anywhere and a status may repeat."""
    out = F.when(before.isNull(), after.isin(*STATUSES)).when(before == after, True)
    for a, bs in TRANSITIONS.items():
        out = out.when(before == a, after.isin(*bs) if bs else F.lit(False))
    return F.coalesce(out.otherwise(False), F.lit(False))


def violations(events: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Events whose status may not follow the job's previous one, with previous_status."""
    before = F.lag("status").over(Window.partitionBy(job).orderBy(*order))
    return events.withColumn("previous_status", before).where(~is_allowed(F.col("previous_status"), F.col("status")))


def snapshot(events: DataFrame, job: str = "job_id", order: str = "seq", at: str = "at") -> DataFrame:
    """One row a job: of each column the last value that is not null, created_at and updated_at. One shuffle, partial aggregates."""
    rest = [c for c in events.columns if c not in (job, order, at)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    return events.groupBy(job).agg(*last, F.min(at).alias("created_at"), F.max(at).alias("updated_at"))


def retry_decision(df: DataFrame, status: str = "status", retry_count: str = "retry_count", error: str = "error_kind", message: str = "error", back_to: str = "transient_status") -> DataFrame:
    """Adds next_status, next_retry, error_message and again (whether the message stays to be delivered again). A passing error sends
    the job back while it has retries left; where it may not go back it keeps status and count. Others fail it."""
    again = ~F.col(error).isin(*PERSISTENT) & (F.col(retry_count) < MAX_RETRIES)
    back = again & is_allowed(F.col(status), F.col(back_to))
    ended = F.col(status).isin(*TERMINAL)
    n = F.col(retry_count) + 1
    told = F.when(again, F.when(back, F.concat(F.lit("Transient failure (Retry #"), n.cast("string"), F.lit("): "), F.col(message)))).when(~ended, F.concat(F.lit("Failed: "), F.col(message)))
    return df.withColumns({
        "again": again,
        "next_status": F.when(again, F.when(back, F.col(back_to)).otherwise(F.col(status))).when(ended, F.col(status)).otherwise("failed"),
        "next_retry": F.when(back, n).otherwise(F.col(retry_count)).cast("int"),
        "error_message": told,
    })


def requeue(jobs: DataFrame) -> DataFrame:
    """Messages for all queued jobs, oldest first."""
    waiting = jobs.where(F.col("status") == "queued").orderBy("created_at", "job_id")
    return waiting.select("job_id", "tenant_id", "input_file_path", F.lit(0).alias("retry_count"))


def open_messages(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages with their job's status and ground truth. error_kind is value where there is no such job; messages of ended jobs are left out."""
    known = jobs.select("job_id", "status", "ground_truth", F.lit(True).alias("known"))
    joined = messages.join(known, "job_id", "left").where(F.col("status").isNull() | ~F.col("status").isin(*TERMINAL))
    return joined.withColumn("error_kind", F.when(F.col("known").isNull(), "value")).drop("known")


def deduplicate(messages: DataFrame, key: str = "message_id") -> DataFrame:
    return messages.dropDuplicates([key])


def reclaim(jobs: DataFrame, now: Column, idle_seconds: int = 300, limit: int = 10) -> DataFrame:
    """Messages whose consumer fell silent: jobs that were begun, and not touched for longer than idle_seconds, the oldest first and up to limit in one pass. Adds 1 to
    retry_count; failed says that this is one too many. A bounded top, which each task cuts first."""
    idle = F.timestamp_diff("MICROSECOND", F.col("updated_at"), now) > idle_seconds * 1_000_000
    silent = jobs.where(F.col("status").isin(*(s for s in IN_FLIGHT if s != "queued")) & idle).orderBy("updated_at", "job_id").limit(limit)
    count = F.coalesce("retry_count", F.lit(0))
    return silent.select("job_id", "tenant_id", "input_file_path", "status", F.when(count >= MAX_RETRIES, count).otherwise(count + 1).cast("int").alias("retry_count"), (count >= MAX_RETRIES).alias("failed"))


def seed_tenants(spark: SparkSession) -> DataFrame:
    """The tenants that a new store begins with."""
    return spark.createDataFrame([("00000000-0000-0000-0000-000000000001", "default", "{}", 100)], TENANT)


def tenant_of(tenants: DataFrame, name: str = "default") -> str:
    """The id of the first tenant of that name."""
    found = tenants.where(F.col("name") == name).orderBy("id").select("id").first()
    if found is None:
        raise LookupError(f"no tenant is named {name}")
    return found["id"]


#: The columns of the list of all jobs, and of what is told about one.
RECORD = ("id", "tenant_id", "status", "input_file_path", "confidence_score", "ocr_data", "extraction_data", "evaluation_data", "ground_truth", "error_message", "retry_count", "created_at", "updated_at")
STATUS = ("job_id", "status", "input_file_path", "confidence_score", "ocr_data", "extraction_data", "evaluation_data", "ground_truth", "error_message", "created_at", "updated_at")


def records(jobs: DataFrame) -> DataFrame:
    """All jobs, the latest first."""
    named = jobs.withColumn("id", F.col("job_id"))
    return named.orderBy(F.desc("created_at"), "id").select(*RECORD)


def status_of(jobs: DataFrame, job_id: str) -> dict | None:
    """What is told about one job; None if there is none of that id."""
    found = jobs.where(F.col("job_id") == job_id).select(*STATUS).first()
    return None if found is None else found.asDict(recursive=True)
