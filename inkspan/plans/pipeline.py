"""The document pipeline in three stages, each a function from messages to job events and the next messages. Batch and streaming run the same ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import paths
from inkspan.operators import engines, evaluation, images, jobs
from inkspan.operators.jobs import retry_decision
from inkspan.schemas import JOB_EVENT
from inkspan.sources.staging import Keep

#: How many event numbers an attempt of a job may use.
ATTEMPT = 100


@dataclass(frozen=True)
class Settings:
    ocr_engine: str = "embedded"
    preprocess: bool = True
    layout: bool = True
    fallback: bool = True
    layout_model: str | None = None
    extractor: str = "labels"
    extractor_settings: dict = field(default_factory=dict)
    bucket: str = paths.BUCKET


def event(job: Column, number: Column, at: Column, status: Column, **values: Column) -> list[Column]:
    """The columns of a job event; values not given are null."""
    given = {"job_id": job, "seq": number.cast("long"), "at": at, "status": status, **values}
    return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOB_EVENT.fields]


def ingest(uploads: DataFrame, tenant_id: str, at: Column, bucket: str = paths.BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """uploads(filename, content, ground_truth): (accepted with job_id and input_file_path, job events, rejected with a reason). A job's id is made of its tenant, name and
    content, so a repeated upload is the same job. Events are to be written before messages."""
    digest = F.sha2(F.concat_ws("/", F.lit(tenant_id), "filename", F.sha2("content", 256)), 256)
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.lit("8"), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    empty = (F.coalesce("filename", F.lit("")) == "") | F.col("content").isNull() | (F.length("content") == 0)
    judged = uploads.withColumn("reason", F.when(empty, "empty file").when(~paths.is_allowed(F.col("filename")), F.concat(F.lit("Unsupported file type: "), paths.extension(F.col("filename")))))
    accepted = judged.where("reason is null").drop("reason").withColumn("job_id", uuid).dropDuplicates(["job_id"]).withColumn("tenant_id", F.lit(tenant_id))
    accepted = accepted.withColumn("input_file_path", paths.input_path(F.col("tenant_id"), F.col("job_id"), F.col("filename"), bucket))
    queued = accepted.select(*event(F.col("job_id"), F.lit(0), at, F.lit("queued"), tenant_id=F.col("tenant_id"), input_file_path=F.col("input_file_path"), retry_count=F.lit(0), ground_truth=F.col("ground_truth")))
    return accepted, queued, judged.where("reason is not null")


def messages_of(accepted: DataFrame) -> DataFrame:
    return accepted.select("job_id", "tenant_id", "input_file_path", F.lit(0).alias("retry_count"))


def well_formed(messages: DataFrame) -> DataFrame:
    """Messages that lack an id or a path, or whose id is no UUID, are dropped."""
    there = paths.is_uuid(F.col("job_id")) & (F.coalesce("tenant_id", F.lit("")) != "") & (F.coalesce("input_file_path", F.lit("")) != "")
    return messages.where(there).withColumn("retry_count", F.coalesce("retry_count", F.lit(0)))


def _steps(df: DataFrame, at: Column, statuses: list[tuple[str, int]], **values: Column) -> DataFrame:
    """One event a row and status, numbered within the attempt."""
    first = F.col("retry_count") * ATTEMPT
    made = F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.lit(n).alias("n")) for s, n in statuses)))
    return df.withColumn("_s", made).select(*event(F.col("job_id"), first + F.col("_s.n"), at, F.col("_s.status"), **values))


def _failures(df: DataFrame, at: Column, status: str, back_to: str) -> DataFrame:
    """Rows with error_kind and error: what a retry makes of each."""
    return retry_decision(df.withColumns({"status": F.lit(status), "transient_status": F.lit(back_to)}))


def _failed_events(decided: DataFrame, at: Column) -> DataFrame:
    return decided.select(*event(F.col("job_id"), F.col("retry_count") * ATTEMPT + 90, at, F.col("next_status"), retry_count=F.col("next_retry"), error_message=F.col("error_message")))


def process(messages: DataFrame, fetch: Callable[[DataFrame, str], DataFrame], at: Column, keep: Keep, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """messages of the intake; fetch adds content, the object at a column's path. recognised: the rows with ocr_output and extraction; events; objects(path, content): what
    was read and extracted, as JSON; next: messages for the output stage; again: messages to be delivered once more. keep writes what the engines make once for all."""
    # an object that is not there is an error that may pass
    read = fetch(well_formed(messages), "input_file_path").withColumn("file_name", paths.split_path(F.col("input_file_path"))["filename"])
    missing = read.where("content is null").withColumns({"error_kind": F.lit("not_found"), "error": F.concat(F.lit("no object at "), F.col("input_file_path"))})
    there = read.where("content is not null")
    pictures = images.preprocess(there) if settings.preprocess else there.withColumn("processed", F.col("content"))
    blocks = engines.recognise(pictures, settings.ocr_engine, fallback="content" if settings.fallback and settings.preprocess else None)
    if settings.layout and settings.layout_model:
        blocks = engines.find_regions(blocks, settings.layout_model, "content")
    text = engines.ocr_output(blocks, settings.ocr_engine, settings.layout, "layout_regions" if "layout_regions" in blocks.columns else None)
    kept = keep(text.select("job_id", "tenant_id", "input_file_path", "retry_count", "ocr_output"), "recognised")
    done = keep(engines.extract(kept, settings.extractor, **settings.extractor_settings), "extracted")
    good = done.where("extraction_error is null")
    bad = done.where("extraction_error is not null").withColumns({"error_kind": F.col("extraction_error"), "error": F.lit("no valid extraction")})
    lost = _failures(missing.select("job_id", "tenant_id", "input_file_path", "retry_count", "error_kind", "error"), at, "ocr_processing", "queued")
    unread = _failures(bad.select("job_id", "tenant_id", "input_file_path", "retry_count", "error_kind", "error"), at, "extracting", "queued")
    decided = lost.unionByName(unread)
    confidence = F.col("ocr_output.average_confidence")
    started = _steps(read, at, [("ocr_processing", 1)])
    passed = _steps(good, at, [("ocr_done", 2), ("extracting", 3), ("extracted", 4)], confidence_score=confidence)
    half = _steps(done.where("extraction_error is not null"), at, [("ocr_done", 2), ("extracting", 3)], confidence_score=confidence)
    path = paths.output_path(F.col("tenant_id"), F.col("job_id"), "ocr_output.json")
    nexts = good.select("job_id", "tenant_id", path.alias("ocr_output_path"), confidence.alias("ocr_confidence"), F.to_json("extraction", {"ignoreNullFields": "false"}).alias("extraction_data"), F.lit(0).alias("retry_count"))
    again = decided.where("again").select("job_id", "tenant_id", "input_file_path", F.col("next_retry").alias("retry_count"))
    said = done.select("tenant_id", "job_id", F.lit("ocr_output.json").alias("name"), F.to_json("ocr_output", {"ignoreNullFields": "false"}).alias("text"))
    said = said.unionByName(good.select("tenant_id", "job_id", F.lit("extraction.json").alias("name"), F.to_json("extraction", {"ignoreNullFields": "false"}).alias("text")))
    made = said.select(F.concat_ws("/", F.lit(settings.bucket), "tenant_id", "job_id", "name").alias("path"), F.col("text").cast("binary").alias("content"))
    return {"recognised": done, "objects": made, "events": started.unionByName(passed).unionByName(half).unionByName(_failed_events(decided, at)), "next": nexts, "again": again}


def finish(messages: DataFrame, current: DataFrame, at: Column, keep: Keep) -> dict[str, DataFrame]:
    """messages of the processing stage and the jobs' snapshot: validation, evaluation, final output. Ended jobs are left alone; an unknown job is an error."""
    known = jobs.open_messages(messages.withColumn("retry_count", F.coalesce("retry_count", F.lit(0))), current)
    read = keep(known.withColumn("_read", evaluation.parse_extraction(F.col("extraction_data"))), "parsed")
    judged = read.withColumn("extraction", F.col("_read.value")).withColumn("error_kind", F.coalesce("error_kind", F.when(~F.col("_read.valid"), "value"), F.when(~evaluation.is_valid(F.col("extraction")), "value"))).drop("_read")
    scored = evaluation.evaluate(judged).withColumn("error_kind", F.coalesce("error_kind", "evaluation_error"))
    scored = keep(scored, "scored")
    good = scored.where("error_kind is null")
    bad = scored.where("error_kind is not null").withColumn("error", F.lit("Business validation failed: mandatory fields are missing or empty, or the job or its ground truth cannot be read"))
    decided = _failures(bad.select("job_id", "tenant_id", "ocr_output_path", "ocr_confidence", "extraction_data", "retry_count", "error_kind", "error"), at, "extracted", "extracted")
    output = good.select("job_id", "tenant_id", paths.output_path(F.col("tenant_id"), F.col("job_id"), "final_output.json").alias("key"), evaluation.final_output(F.col("job_id"), F.col("ocr_confidence"), F.col("extraction"), F.col("evaluation")).alias("final_output"))
    finished = _steps(good, at, [("done", 5)], evaluation_data=F.col("evaluation"))
    again = decided.where("again").select("job_id", "tenant_id", "ocr_output_path", "ocr_confidence", "extraction_data", F.col("next_retry").alias("retry_count"))
    return {"output": output, "events": finished.unionByName(_failed_events(decided, at)), "again": again}
