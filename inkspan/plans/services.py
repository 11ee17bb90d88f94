"""Queries on sources, sinks, engines and the streaming service. Each writes below a folder of its own and reads back what it did; the SQL beside it tells what
should be there."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from inkspan.functions import image_kernels as kernels
from inkspan.functions import prompts
from inkspan.operators import benchmark, engines, jobs, layout
from inkspan.plans.catalogue import NOW, evaluated_jobs, query
from inkspan.plans.derived import sql, view
from inkspan.plans.pipeline import Settings, messages_of, process, well_formed
from inkspan.schemas import INGESTED, REGION, TEXT_BLOCK
from inkspan.sources.files import Objects, dataset, pictures, truths, with_truths
from inkspan.sources.staging import keep_in, scratch
from inkspan.streaming.topics import Topics
from inkspan.streaming.workers import Service


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page(lines: list[str], regions: list[dict] | None = None) -> bytes:
    """A small white picture that carries its own text, one block a line."""
    blocks = [{"text": t, "confidence": 0.8, "bbox": [10, 30 * k, 200, 30 * k + 20]} for k, t in enumerate(lines)]
    return kernels.encode_png(np.full((24, 32), 255, np.uint8), {"blocks": json.dumps(blocks)} | ({"regions": json.dumps(regions)} if regions is not None else {}))


# objects


def _nation_objects(spark: SparkSession, sf_dir: str) -> Objects:
    """An object for each nation; those with an even key are written again, every fifth is deleted twice."""
    store, n = Objects(spark, scratch(spark)), table(spark, sf_dir, "nation")
    at = F.format_string("names/r%d/n%d.json", "n_regionkey", "n_nationkey").alias("path")
    store.put_all(n.select(at, F.col("n_name").cast("binary").alias("content")))
    store.put_all(n.where("n_nationkey % 2 = 0").select(at, F.concat("n_name", F.lit(" again")).cast("binary").alias("content")))
    for _ in range(2):
        store.delete_all(n.where("n_nationkey % 5 = 0").select(at))
    return store


@query
def blob_put(spark, sf_dir):
    """What is there after writing, writing over and deleting."""
    found = _nation_objects(spark, sf_dir).listing("names")
    return found.select("path", F.col("length").cast("long").alias("length"), F.md5("content").alias("digest"))


@query
def blob_get(spark, sf_dir):
    """Every nation's object by its path; none where it was deleted."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.format_string("names/r%d/n%d.json", "n_regionkey", "n_nationkey").alias("path"))
    got = _nation_objects(spark, sf_dir).with_content(n, "path")
    return got.select("n_nationkey", F.col("content").cast("string").alias("text"))


@query
def blob_exists(spark, sf_dir):
    """Paths that are in the listing."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.format_string("names/r%d/n%d.json", "n_regionkey", "n_nationkey").alias("path"))
    return n.join(_nation_objects(spark, sf_dir).listing("names").select("path"), "path", "left_semi").select("n_nationkey")


@query
def atomic_write(spark, sf_dir):
    """A write that fails leaves nothing to be read; the next one is whole."""
    keep, n = keep_in(scratch(spark)), table(spark, sf_dir, "nation")
    seen = 0
    try:
        keep(n.withColumn("x", F.when(F.col("n_nationkey") == 24, F.raise_error(F.lit("lost"))).otherwise(F.lit("1"))), "names")
        seen = -1
    except Exception:  # noqa: BLE001  the error that was asked for
        pass
    return keep(n.withColumn("x", F.lit("2")), "names").groupBy("x").agg(F.count("*").alias("n")).withColumn("seen_before", F.lit(seen))


# datasets and folders


@query
def dataset_scan(spark, sf_dir):
    """Events as a dataset's split of several files: ids where they are missing, labels that are no JSON, none at all."""
    e, folder = table(spark, sf_dir, "events"), scratch(spark)
    label = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "event_type")).when(F.col("event_id") % 5 != 1, F.col("props"))
    rows = e.select("event_id", F.col("event_type").cast("binary").alias("image"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("id"), label.alias("parsed_data"))
    rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").drop("event_id").write.parquet(f"{folder}/test")
    return dataset(spark, folder).select("id", F.col("image").cast("string").alias("image"), F.md5(F.col("ground_truth").cast("binary")).alias("digest"))


@query
def dataset_ingest(spark, sf_dir):
    """A few rows are taken in at once, many by a thread: what the caller is told, and what is there in the end."""
    folder, told = scratch(spark), []
    table(spark, sf_dir, "nation").select(F.col("n_name").cast("binary").alias("image"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")).coalesce(1).write.parquet(f"{folder}/d/test")
    for limit in (2, 6):
        service = Service(spark, f"{folder}/s{limit}")
        at_once = service.submit_dataset(f"{folder}/d", "t", "1", limit=limit)
        service.wait()
        told.append((limit, at_once, service.jobs().count()))
    return spark.createDataFrame(told, "asked int, told long, there long")


def _picture_folder(spark: SparkSession, sf_dir: str) -> str:
    """A picture of each nation, by extension; texts of all but every fourth."""
    folder, n = scratch(spark), table(spark, sf_dir, "nation")
    ends = F.element_at(F.array(*map(F.lit, ("png", "jpg", "jpeg", "PNG", "gif"))), F.col("n_nationkey") % 5 + 1)

    @pandas_udf("binary")
    def drawn(names: pd.Series) -> pd.Series:
        return pd.Series([_page([f"Name {x}", "0ne"]) for x in names])

    store = Objects(spark, folder)
    store.put_all(n.select(F.concat(F.lit("p/n"), F.col("n_nationkey").cast("string"), F.lit("."), ends).alias("path"), drawn("n_name").alias("content")))
    store.put_all(n.where("n_nationkey % 4 != 0").select(F.concat(F.lit("p/n"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("Name "), "n_name", F.lit("\nOne")).cast("binary").alias("content")))
    return f"{folder}/p"


@query
def picture_folder(spark, sf_dir):
    """Pictures by their endings, with their texts."""
    folder = _picture_folder(spark, sf_dir)
    return with_truths(pictures(spark, folder), truths(spark, folder)).select("file_name", "truth")


@query
def ab_benchmark(spark, sf_dir):
    """Three variants of the engine over a folder of pictures; those without a text have no rates."""
    folder = _picture_folder(spark, sf_dir)
    variants = (*benchmark.DEFAULT, ("flat_no_layout", False, False, "blocks as they come"))
    s = benchmark.summarise(benchmark.run(spark, with_truths(pictures(spark, folder), truths(spark, folder)), variants))
    return s.select("config", "n", *(F.round(c, 6).alias(c) for c in ("avg_confidence", "avg_cer", "avg_wer")), (F.col("avg_latency") > 0).alias("timed"))


# engines


@query
def engine_registry(spark, sf_dir):
    """What each name makes."""
    tried = [("ocr", "PaddleOCR", engines.ocr_engine), ("ocr", "embedded", engines.ocr_engine), ("ocr", "other", engines.ocr_engine), ("layout", "embedded", engines.layout_model), ("layout", "other", engines.layout_model), ("extractor", "ollama", engines.extractor), ("extractor", "gemini", engines.extractor), ("extractor", "labels", engines.extractor), ("extractor", "other", engines.extractor)]

    def outcome(make, name: str) -> str:
        try:
            return "made" if callable(make(name)) else "none"
        except ValueError:
            return "ValueError"

    return spark.createDataFrame([(kind, name, outcome(make, name)) for kind, name, make in tried], "kind string, name string, outcome string")


@query
def extract_repair(spark, sf_dir):
    """Recorded answers: good at once, good after one repair, never good, and a service that was not reached."""
    good = '{"header": {"invoice_no": "N", "invoice_date": "d"}, "items": [], "summary": {"total_net_worth": "5"}}'
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("file_name"))
    answers = {str(k): {0: [good], 1: ["{", good], 2: ["{", "[]"], 3: [None]}[k % 4] for k in range(25)}
    record = F.struct("file_name", F.lit("grid").alias("ocr_engine"), F.lit("text").alias("raw_text"), F.lit(0.5).alias("average_confidence"), F.array().cast(f"array<{TEXT_BLOCK.simpleString()}>").alias("text_blocks"))
    done = engines.extract(n.select("n_nationkey", record.alias("ocr_output")), "recorded", answers=answers)
    return done.select("n_nationkey", F.col("extraction.header.invoice_no").alias("invoice_no"), "extraction_error")


@query
def ocr_run(spark, sf_dir):
    """The embedded engine over pictures; what has no blocks after preprocessing is read again as it came."""
    @pandas_udf("binary")
    def drawn(names: pd.Series) -> pd.Series:
        return pd.Series([_page([f"Name {x}", "x1O0"]) for x in names])

    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file_name"), drawn("n_name").alias("content"))
    lost = n.withColumn("processed", F.when(F.col("n_nationkey") % 3 != 0, F.col("content")).otherwise(F.lit("?").cast("binary"))).withColumn("content", F.when(F.col("n_nationkey") % 6 != 0, F.col("content")).otherwise(F.lit("?").cast("binary")))
    done = engines.ocr_output(engines.recognise(lost, "embedded"), "embedded")
    return done.select("n_nationkey", "ocr_output.file_name", "ocr_output.ocr_engine", "ocr_output.raw_text", F.round("ocr_output.average_confidence", 6).alias("confidence"), F.size("ocr_output.text_blocks").alias("n"))


@query
def layout_regions(spark, sf_dir):
    """Regions by the embedded model, and the page's text with and without a table there."""
    @pandas_udf("binary")
    def drawn(keys: pd.Series) -> pd.Series:
        return pd.Series([_page(["a", "b", "c"], [{"bbox": [0, 0, 300, 100], "label": "table" if k % 2 else "figure", "confidence": 0.5}]) for k in keys])

    n = table(spark, sf_dir, "nation").select("n_nationkey", drawn("n_nationkey").alias("processed"))
    done = layout.reconstruct(engines.find_regions(engines.recognise(n, "embedded", fallback=None), "embedded"), regions="layout_regions")
    return done.select("n_nationkey", F.size("layout_regions").alias("n"), F.col("layout_regions")[0]["label"].alias("label"), F.contains("raw_text", F.lit("|")).alias("as_table"))


@query
def result_parse_lines(spark, sf_dir):
    """Results of the older form: of two pages, only the first counts."""
    p = table(spark, sf_dir, "part")
    points = F.format_string("[[%d.7, 3], [90, 2], [91, %d], [5, 20]]", F.col("p_size"), F.col("p_size") + 30)
    line = F.concat(F.lit("["), points, F.lit(', ["'), "p_brand", F.lit('", 0.25]]'))
    raw = F.when(F.col("p_partkey") % 7 == 0, F.lit("[]")).otherwise(F.concat(F.lit("[["), line, F.lit(","), line, F.lit("], ["), line, F.lit("]]")))
    b = p.select("p_partkey", layout.blocks_of_lines(raw).alias("b"))
    return b.select("p_partkey", F.size("b").alias("n"), F.get("b", F.lit(0))["text"].alias("text"), F.get("b", F.lit(0))["confidence"].alias("confidence"), F.array_join(F.get("b", F.lit(0))["bbox"].cast("array<string>"), ",").alias("bbox"))


@query
def system_prompt(spark, sf_dir):
    """Every field of an extraction is named in the prompt."""
    names = spark.createDataFrame([(f.name,) for part in ("header", "summary") for f in _fields(part)] + [(f.name,) for f in _fields("items")], "field string")
    return names.select("field", F.contains(prompts.system_prompt(), F.col("field")).alias("named"))


def _fields(part: str):
    from inkspan.schemas import HEADER, ITEM, SUMMARY

    return {"header": HEADER, "items": ITEM, "summary": SUMMARY}[part].fields


# jobs


@query
def job_records(spark, sf_dir):
    """All columns of all jobs, the latest first."""
    blank = F.lit(None).cast("string")
    j = evaluated_jobs(spark, sf_dir).withColumns({"ocr_data": blank, "extraction_data": blank, "ground_truth": F.concat(F.lit('{"n": '), F.col("retry_count").cast("string"), F.lit("}")), "evaluation_data": F.to_json(F.struct(F.col("evaluation_data.passed").alias("passed")))})
    return jobs.records(j).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("created_at", "updated_at")}).withColumn("evaluation_data", F.get_json_object("evaluation_data", "$.passed"))


@query
def job_status(spark, sf_dir):
    """What is told about two jobs, and about one that is not there."""
    blank = F.lit(None).cast("string")
    j = view(spark, sf_dir, "jobs").withColumns({c: blank for c in ("ocr_data", "extraction_data", "evaluation_data", "ground_truth")})
    found = {k: jobs.status_of(j, k) for k in ("job-00000007", "job-00000034", "job-none")}
    rows = [(k, f is not None, ",".join(f) if f else None, f["status"] if f else None, f["input_file_path"] if f else None, f["created_at"].strftime("%Y-%m-%d") if f else None) for k, f in found.items()]
    return spark.createDataFrame(rows, "asked string, found boolean, fields string, status string, path string, day string")


@query
def tenant_seed(spark, sf_dir):
    """The tenant that a store begins with, and the jobs of its name; another is not found."""
    seed = jobs.seed_tenants(spark)
    try:
        missing = jobs.tenant_of(seed, "nobody")
    except LookupError:
        missing = "LookupError"
    owned = view(spark, sf_dir, "jobs").join(seed.select(F.col("name").alias("tenant_id")), "tenant_id", "left_semi")
    return owned.agg(F.count("*").alias("n_jobs")).withColumns({"id": F.lit(jobs.tenant_of(seed)), "missing": F.lit(missing)})


@query
def reaper(spark, sf_dir):
    """One pass: the ten oldest jobs whose consumer fell silent."""
    return jobs.reclaim(view(spark, sf_dir, "jobs"), F.lit(NOW).cast("timestamp"))


# topics and workers


@query
def message_validate(spark, sf_dir):
    """Intake messages with a well-formed job id, a tenant and a path; the rest are dropped."""
    j = view(spark, sf_dir, "jobs")
    uuid = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("-0000-4000-8000-00000000000"), F.when(F.col("o_orderkey") % 6 == 0, "g").otherwise("a"))
    m = j.select(uuid.alias("job_id"), F.when(F.col("o_orderkey") % 15 != 0, F.col("tenant_id")).alias("tenant_id"), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.col("input_file_path")).alias("input_file_path"), F.when(F.col("o_orderkey") % 2 == 0, F.col("retry_count")).alias("retry_count"))
    return well_formed(m)


@query
def requeue_publish(spark, sf_dir):
    """Messages of all queued jobs, read back from their topic."""
    topics = Topics(spark, scratch(spark))
    topics.publish(jobs.requeue(view(spark, sf_dir, "jobs")), "queue:ingestion", "requeue")
    return topics.read("queue:ingestion", INGESTED)


def _published(spark: SparkSession, sf_dir: str) -> Topics:
    """A message a nation, in five batches, of which one is published twice."""
    topics, n = Topics(spark, scratch(spark)), table(spark, sf_dir, "nation")
    for k in (0, 1, 2, 3, 4, 1):
        m = n.where(F.col("n_nationkey") % 5 == k).select(F.col("n_name").alias("job_id"), F.lit("t").alias("tenant_id"), F.lit("p").alias("input_file_path"), F.col("n_nationkey").alias("retry_count"))
        topics.publish(m.coalesce(1), "queue:ingestion", str(k))
    return topics


@query
def topic_consume(spark, sf_dir):
    """A consumer that fails in its second micro-batch and begins again: every message has its effect once."""
    topics = _published(spark, sf_dir)
    calls, out = [], f"{topics.root}/handled"

    def handle(batch: DataFrame, number: int) -> None:
        calls.append(number)
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if len(calls) == 2:
            raise RuntimeError("lost after its write, before its commit")

    for _ in range(2):
        stream = topics.subscribe("queue:ingestion", INGESTED, files=1)
        running = stream.writeStream.foreachBatch(handle).option("checkpointLocation", topics.checkpoint("queue:ingestion")).trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        except Exception:  # noqa: BLE001  the error that was asked for
            pass
    handled = spark.read.option("recursiveFileLookup", True).parquet(out)
    return handled.groupBy("job_id", "retry_count").agg(F.count("*").alias("times")).withColumn("replayed", F.lit(len(calls) > len(set(calls))))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of each supplier: some of another kind, some that cannot be read, some that lack a field, with right, wrong and no ground truth."""

    @pandas_udf("binary")
    def drawn(keys: pd.Series) -> pd.Series:
        return pd.Series([b"?" if k % 11 == 0 else _page(["Invoice no: S" + str(k) if k % 7 else "nothing", "Date of issue: 2031-04-09", "Total net worth: 73,50"]) for k in keys])

    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    right = F.concat(F.lit('{"json": {"header": {"invoice_no": "s-'), key, F.lit('", "invoice_date": "09.04.2031"}, "summary": {"total_net_worth": "'), F.when(F.col("s_suppkey") % 3 == 0, "80").otherwise("$ 73.5"), F.lit('"}}}'))
    return s.select(F.concat(F.lit("s"), key, F.when(F.col("s_suppkey") % 5 == 0, ".txt").otherwise(".png")).alias("filename"), drawn("s_suppkey").alias("content"), F.when(F.col("s_suppkey") % 4 != 0, right).alias("ground_truth"))


@query
def service_run(spark, sf_dir):
    """Documents through the whole service: what became of each, and which of its objects are left."""
    from inkspan.plans.pipeline import ingest

    uploads, folder = _uploads(spark, sf_dir), scratch(spark)
    service = Service(spark, folder, Settings(preprocess=False, layout_model="embedded"))
    rejected = service.submit(uploads, "t", "1")
    service.drain(2)
    accepted, _, _ = ingest(uploads, "t", F.current_timestamp())
    left = service.objects.listing("invoices").select(F.element_at(F.split("path", "/"), -2).alias("job_id"), F.element_at(F.split("path", "/"), -1).alias("name")).groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("objects"))
    ended = service.jobs().join(accepted.select("job_id", "filename"), "job_id").join(left, "job_id", "left")
    told = ended.select("filename", "status", F.col("evaluation_data.evaluated").alias("evaluated"), F.col("evaluation_data.passed").alias("passed"), "confidence_score", "objects")
    return told.unionByName(rejected.select("filename", F.lit("rejected").alias("status"), F.lit(None).cast("boolean").alias("evaluated"), F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("double").alias("confidence_score"), F.col("reason").alias("objects")))


@query
def process_stage(spark, sf_dir):
    """The processing stage by itself: its events and messages, and the JSON it leaves, where every sixth picture is missing."""
    store, s = Objects(spark, scratch(spark)), table(spark, sf_dir, "supplier")
    uuid = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit("-0000-4000-8000-00000000000a"))
    docs = _uploads(spark, sf_dir).select(F.regexp_extract("filename", "[0-9]+", 0).cast("long").alias("s_suppkey"), "content")
    m = s.select("s_suppkey", uuid.alias("job_id"), F.lit("t").alias("tenant_id")).withColumn("input_file_path", F.concat_ws("/", F.lit("invoices/t"), "job_id", F.lit("input.png")))
    store.put_all(m.join(docs, "s_suppkey").where("s_suppkey % 6 != 0").select(F.col("input_file_path").alias("path"), "content"))
    done = process(messages_of(m), store.with_content, F.current_timestamp(), keep_in(scratch(spark)), Settings(preprocess=False))
    store.put_all(done["objects"])
    events = done["events"].groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "status"))), lambda e: e["status"]), ",").alias("events"))
    nexts = done["next"].select("job_id", F.lit(True).alias("passed_on"))
    again = done["again"].select("job_id", F.col("retry_count").alias("retry"))
    left = store.listing("invoices").where("path not like '%input.png'").select(F.element_at(F.split("path", "/"), -2).alias("job_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.get_json_object(F.col("content").cast("string"), "$.header.invoice_no").alias("no"))
    made = left.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("objects"), F.max("no").alias("invoice_no"))
    out = events.join(nexts, "job_id", "left").join(again, "job_id", "left").join(made, "job_id", "left")
    return out.select("job_id", "events", F.coalesce("passed_on", F.lit(False)).alias("passed_on"), "retry", "objects", "invoice_no")


# SQL


def oracle_sql() -> dict[str, str]:
    job = f"WITH jobs AS ({sql('jobs', True)})"
    named = "'names/r' || n_regionkey || '/n' || n_nationkey || '.json'"
    ends = "['png', 'jpg', 'jpeg', 'PNG', 'gif'][n_nationkey % 5 + 1]"
    seen = "n_nationkey % 5 < 3"
    status = ",".join(jobs.STATUS)
    fields = " UNION ALL ".join(f"SELECT '{f.name}' AS field, true AS named" for part in ("header", "summary", "items") for f in _fields(part))
    readable = "s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0"
    return {
        "blob_put": f"SELECT {named} AS path, length(n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' again' ELSE '' END)::BIGINT AS length, md5(n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' again' ELSE '' END) AS digest FROM nation WHERE n_nationkey % 5 <> 0",
        "blob_get": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' again' ELSE '' END END AS text FROM nation",
        "blob_exists": "SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0",
        "atomic_write": "SELECT '2' AS x, count(*) AS n, 0 AS seen_before FROM nation",
        "dataset_scan": """WITH l AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS n, CASE WHEN event_id % 5 = 0 THEN '{' || event_type WHEN event_id % 5 <> 1 THEN props END AS label FROM events)
          SELECT CASE WHEN event_id % 3 <> 0 THEN 'e' || event_id ELSE 'hf_' || n END AS id, event_type AS image, md5(CASE WHEN label IS NULL THEN '{}' WHEN json_valid(label) THEN label ELSE '{"raw":"' || label || '"}' END) AS digest FROM l""",
        "dataset_ingest": "SELECT 2 AS asked, 2::BIGINT AS told, 2::BIGINT AS there UNION ALL SELECT 6, 0, 6",
        "picture_folder": f"SELECT 'n' || n_nationkey || '.' || {ends} AS file_name, CASE WHEN n_nationkey % 4 <> 0 THEN 'Name ' || n_name || chr(10) || 'One' ELSE '' END AS truth FROM nation WHERE {seen}",
        "ab_benchmark": f"""WITH v AS (SELECT unnest(['baseline_with_preprocess', 'raw_no_preprocess', 'flat_no_layout']) AS config), r AS (SELECT config, n_nationkey % 4 <> 0 AS scored, length('Name ' || n_name || chr(10) || 'One') AS chars, len(string_split(n_name, ' ')) + 2 AS words FROM nation, v WHERE {seen})
          SELECT config, count(*) AS n, 0.8::DOUBLE AS avg_confidence, round(avg(CASE WHEN scored THEN 1 / chars END), 6) AS avg_cer, round(avg(CASE WHEN scored THEN 1 / words END), 6) AS avg_wer, true AS timed FROM r GROUP BY config""",
        "engine_registry": "SELECT unnest(['ocr', 'ocr', 'ocr', 'layout', 'layout', 'extractor', 'extractor', 'extractor', 'extractor']) AS kind, unnest(['PaddleOCR', 'embedded', 'other', 'embedded', 'other', 'ollama', 'gemini', 'labels', 'other']) AS name, unnest(['made', 'made', 'ValueError', 'made', 'ValueError', 'made', 'ValueError', 'made', 'ValueError']) AS outcome",
        "extract_repair": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 < 2 THEN 'N' END AS invoice_no, CASE n_nationkey % 4 WHEN 2 THEN 'persistent' WHEN 3 THEN 'transient' END AS extraction_error FROM nation",
        "ocr_run": "SELECT n_nationkey, 'f' || n_nationkey AS file_name, 'embedded' AS ocr_engine, CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE 'Name ' || n_name || chr(10) || 'x100' END AS raw_text, CASE WHEN n_nationkey % 6 = 0 THEN 0.0 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE 2 END AS n FROM nation",
        "layout_regions": "SELECT n_nationkey, 1 AS n, CASE WHEN n_nationkey % 2 = 1 THEN 'table' ELSE 'figure' END AS label, n_nationkey % 2 = 1 AS as_table FROM nation",
        "result_parse_lines": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS text, CASE WHEN p_partkey % 7 <> 0 THEN 0.25::DOUBLE END AS confidence, CASE WHEN p_partkey % 7 <> 0 THEN least(p_size, 5) || ',2,91,' || (p_size + 30) END AS bbox FROM part",
        "system_prompt": fields,
        "job_status": f"{job}, a AS (SELECT unnest(['job-00000007', 'job-00000034', 'job-none']) AS asked) SELECT asked, job_id IS NOT NULL AS found, CASE WHEN job_id IS NOT NULL THEN '{status}' END AS fields, status, input_file_path AS path, strftime(created_at, '%Y-%m-%d') AS day FROM a LEFT JOIN jobs ON job_id = asked",
        "tenant_seed": f"{job} SELECT count(*) AS n_jobs, '00000000-0000-0000-0000-000000000001' AS id, 'LookupError' AS missing FROM jobs WHERE tenant_id = 'default'",
        "reaper": f"""{job} SELECT job_id, tenant_id, input_file_path, status, CASE WHEN retry_count >= 3 THEN retry_count ELSE retry_count + 1 END::INT AS retry_count, retry_count >= 3 AS failed FROM jobs
          WHERE status IN ('ocr_processing', 'extracting', 'validating', 'ocr_done', 'extracted') AND date_diff('microsecond', updated_at, TIMESTAMP '{NOW}') > 300000000 ORDER BY updated_at, job_id LIMIT 10""",
        "message_validate": f"{job} SELECT lpad(o_orderkey::VARCHAR, 8, '0') || '-0000-4000-8000-00000000000a' AS job_id, tenant_id, input_file_path, CASE WHEN o_orderkey % 2 = 0 THEN retry_count ELSE 0 END::INT AS retry_count FROM jobs WHERE o_orderkey % 6 <> 0 AND o_orderkey % 10 <> 0 AND o_orderkey % 15 <> 0",
        "requeue_publish": f"{job} SELECT job_id, tenant_id, input_file_path, 0 AS retry_count FROM jobs WHERE status = 'queued'",
        "topic_consume": "SELECT n_name AS job_id, n_nationkey AS retry_count, 1::BIGINT AS times, true AS replayed FROM nation",
        "service_run": f"""WITH s AS (SELECT *, 's' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN '.txt' ELSE '.png' END AS filename, {readable} AS fine FROM supplier)
          SELECT filename, CASE WHEN s_suppkey % 5 = 0 THEN 'rejected' WHEN fine THEN 'done' ELSE 'failed' END AS status, CASE WHEN s_suppkey % 5 <> 0 AND fine THEN s_suppkey % 4 <> 0 END AS evaluated, CASE WHEN s_suppkey % 5 <> 0 AND fine THEN s_suppkey % 4 = 0 OR s_suppkey % 3 <> 0 END AS passed,
          CASE WHEN s_suppkey % 5 <> 0 THEN CASE WHEN s_suppkey % 11 = 0 THEN 0.0 ELSE 0.8 END END::DOUBLE AS confidence_score, CASE WHEN s_suppkey % 5 = 0 THEN 'Unsupported file type: txt' WHEN fine THEN 'final_output.json,input.png' ELSE 'extraction.json,input.png,ocr_output.json' END AS objects FROM s""",
        "process_stage": """SELECT lpad(s_suppkey::VARCHAR, 8, '0') || '-0000-4000-8000-00000000000a' AS job_id, CASE WHEN s_suppkey % 6 = 0 THEN 'ocr_processing,queued' ELSE 'ocr_processing,ocr_done,extracting,extracted' END AS events, s_suppkey % 6 <> 0 AS passed_on,
          CASE WHEN s_suppkey % 6 = 0 THEN 1 END AS retry, CASE WHEN s_suppkey % 6 <> 0 THEN 'extraction.json,ocr_output.json' END AS objects, CASE WHEN s_suppkey % 6 <> 0 THEN CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 THEN 'S' || s_suppkey ELSE '' END END AS invoice_no FROM supplier""",
    }
