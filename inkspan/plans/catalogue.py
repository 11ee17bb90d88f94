"""The queries that the driver runs: one for each operator, over views derived from its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import paths, prompts
from inkspan.functions.amounts import amounts_match, parse_amount
from inkspan.functions.dates import dates_match, parse_date
from inkspan.functions.invoice_numbers import normalise_number, numbers_match
from inkspan.functions.metrics import character_error_rate, fields_match, word_error_rate
from inkspan.functions.repair import repair_text
from inkspan.operators import analytics, evaluation, image_quality, jobs, layout
from inkspan.plans.derived import spread, view
from inkspan.schemas import IN_FLIGHT

NOW = "1998-08-02 00:20:00"
FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    FOUND[f.__name__] = f
    return f


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with an extraction of the schema, items included, and their ground truth."""
    invoices = view(spark, sf_dir, "invoices")
    blank = F.lit(None).cast("string")
    item = F.struct(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("item_desc"), blank.alias("item_qty"), blank.alias("item_net_price"), "item_net_worth", blank.alias("item_vat"), blank.alias("item_gross_worth"))
    items = view(spark, sf_dir, "line_items").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    no = F.when(F.col("o_orderkey") % 23 == 0, F.lit("  ")).otherwise(F.col("invoice_no"))
    header = F.struct(no.alias("invoice_no"), "invoice_date", blank.alias("seller"), F.col("client"), blank.alias("seller_tax_id"), blank.alias("client_tax_id"), blank.alias("iban"))
    summary = F.struct("total_net_worth", blank.alias("total_vat"), blank.alias("total_gross_worth"))
    made = invoices.join(items, "o_orderkey", "left")
    none = F.expr("cast(array() as array<struct<item_desc:string,item_qty:string,item_net_price:string,item_net_worth:string,item_vat:string,item_gross_worth:string>>)")
    return made.select("o_orderkey", F.struct(header.alias("header"), F.coalesce("items", none).alias("items"), summary.alias("summary")).alias("extraction"), "ground_truth")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As extractions, without items: no join with them."""
    blank = F.lit(None).cast("string")
    header = F.struct("invoice_no", "invoice_date", blank.alias("seller"))
    return view(spark, sf_dir, "invoices").select("o_orderkey", F.struct(header.alias("header"), F.struct("total_net_worth").alias("summary")).alias("extraction"), "ground_truth")


def evaluated_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with evaluation_data, which every seventh lacks."""
    scored = evaluation.evaluate(headers(spark, sf_dir), python_literals=False).select("o_orderkey", F.col("evaluation").alias("evaluation_data"))
    joined = view(spark, sf_dir, "jobs").join(scored, "o_orderkey")
    return joined.withColumn("evaluation_data", F.when(F.col("o_orderkey") % 7 != 3, F.col("evaluation_data")))


@query
def kpi_summary(spark, sf_dir):
    k = analytics.kpi(evaluated_jobs(spark, sf_dir))
    return k.select("total", "passed_count", "rating", "accuracy_rating", "n_confidence", *(F.round(c, 6).alias(c) for c in ("avg_invoice_no", "avg_invoice_date", "avg_total_net_worth", "avg_overall", "avg_confidence", "pass_rate")))


@query
def amount_parse(spark, sf_dir):
    return view(spark, sf_dir, "amount_texts").select("l_orderkey", "l_linenumber", "raw", parse_amount(F.col("raw")).alias("amount"))


@query
def amount_match(spark, sf_dir):
    i = view(spark, sf_dir, "invoices")
    return i.select("o_orderkey", amounts_match(F.col("total_net_worth"), F.col("gt_total")).alias("same"))


@query
def date_parse(spark, sf_dir):
    i = view(spark, sf_dir, "invoices")
    return i.select("o_orderkey", "invoice_date", F.date_format(parse_date(F.col("invoice_date")), "yyyy-MM-dd").alias("day"))


@query
def date_match(spark, sf_dir):
    i = view(spark, sf_dir, "invoices")
    return i.select("o_orderkey", dates_match(F.col("invoice_date"), F.col("gt_date")).alias("same"))


@query
def invoice_no_normalise(spark, sf_dir):
    return view(spark, sf_dir, "invoices").select("o_orderkey", normalise_number(F.col("gt_no")).alias("bare"))


@query
def invoice_no_match(spark, sf_dir):
    i = view(spark, sf_dir, "invoices")
    return i.select("o_orderkey", numbers_match(F.col("invoice_no"), F.col("gt_no")).alias("same"))


@query
def ocr_fix(spark, sf_dir):
    return view(spark, sf_dir, "noisy").select("l_orderkey", "l_linenumber", "l_extendedprice", repair_text(F.col("raw")).alias("fixed"))


@query
def validate_extraction(spark, sf_dir):
    e = extractions(spark, sf_dir)
    return e.select("o_orderkey", evaluation.is_valid(F.col("extraction")).alias("valid"))


@query
def items_sum_check(spark, sf_dir):
    e = extractions(spark, sf_dir)
    return e.select("o_orderkey", F.size("extraction.items").alias("n_items"), evaluation.items_sum_differs(F.col("extraction")).alias("differs"))


@query
def extraction_parse(spark, sf_dir):
    """The JSON of an extraction read back: whole, without its date, and broken."""
    text = F.to_json("extraction", {"ignoreNullFields": "false"})
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.substring(text, F.lit(1), F.length(text) - 3)).when(F.col("o_orderkey") % 5 == 1, F.regexp_replace(text, '"invoice_date":"[^"]*"', '"invoice_date":null')).otherwise(text)
    read = extractions(spark, sf_dir).select("o_orderkey", evaluation.parse_extraction(raw).alias("read"))
    return read.select("o_orderkey", "read.valid", F.when(F.col("read.valid"), F.col("read.value.header.invoice_no")).alias("invoice_no"))


def _verdicts(df):
    e = F.col("evaluation")
    return df.select("o_orderkey", e["evaluated"].alias("evaluated"), e["passed"].alias("passed"), *(e["field_accuracies"][n].alias(n) for n in ("invoice_no", "invoice_date", "total_net_worth")))


@query
def evaluate(spark, sf_dir):
    return _verdicts(evaluation.evaluate(headers(spark, sf_dir), python_literals=False))


@query
def evaluate_pyliteral(spark, sf_dir):
    """Ground truth as a Python literal inside the JSON."""
    quoted = F.concat(F.lit('{"json": "'), F.replace(F.col("ground_truth_inner"), F.lit('"'), F.lit("'")), F.lit('"}'))
    h = headers(spark, sf_dir).join(view(spark, sf_dir, "invoices").select("o_orderkey", F.col("inner_json").alias("ground_truth_inner")), "o_orderkey")
    return _verdicts(evaluation.evaluate(h.withColumn("ground_truth", quoted)))


@query
def field_accuracy(spark, sf_dir):
    return analytics.field_accuracy(evaluated_jobs(spark, sf_dir))


@query
def status_counts(spark, sf_dir):
    return analytics.status_counts(view(spark, sf_dir, "jobs"))


@query
def latency_hist(spark, sf_dir):
    h = analytics.latency_histogram(evaluated_jobs(spark, sf_dir))
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "cnt")


@query
def confidence_hist(spark, sf_dir):
    h = analytics.confidence_histogram(evaluated_jobs(spark, sf_dir))
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "cnt")


@query
def stuck_jobs(spark, sf_dir):
    s = analytics.stuck(view(spark, sf_dir, "jobs"), F.lit(NOW).cast("timestamp"))
    return s.select("job_id", "status", F.round("minutes", 3).alias("minutes"))


@query
def stuck_page(spark, sf_dir):
    s = analytics.stuck(view(spark, sf_dir, "jobs"), F.lit(NOW).cast("timestamp"))
    return analytics.page(s, 3, [F.desc("created_at"), F.col("job_id")]).select("job_id", "status", "page", "pages")


@query
def job_history(spark, sf_dir):
    return analytics.history(view(spark, sf_dir, "jobs"))


@query
def all_jobs(spark, sf_dir):
    j = view(spark, sf_dir, "jobs").orderBy(F.desc("created_at"), "job_id")
    return j.select("job_id", "tenant_id", "status", "input_file_path", "confidence_score", "retry_count", "error_message")


@query
def detail_table(spark, sf_dir):
    return analytics.details(evaluated_jobs(spark, sf_dir))


@query
def done_jobs(spark, sf_dir):
    return analytics.evaluated(evaluated_jobs(spark, sf_dir)).select("job_id", "confidence_score", F.col("evaluation_data.passed").alias("passed"))


@query
def job_lookup(spark, sf_dir):
    return view(spark, sf_dir, "jobs").where(F.col("job_id") == "job-00000007").select("job_id", "status", "input_file_path", "retry_count")


@query
def tenant_lookup(spark, sf_dir):
    """The first job's tenant row by name, and the jobs it owns."""
    tenants = spark.createDataFrame([("default", 100), ("other", 10)], "name string, rate_limit int")
    one = tenants.where(F.col("name") == "default").limit(1)
    j = view(spark, sf_dir, "jobs")
    return j.join(F.broadcast(one), j.tenant_id == one.name).groupBy("name", "rate_limit").agg(F.count("*").alias("n_jobs"))


@query
def transition_violations(spark, sf_dir):
    return jobs.violations(view(spark, sf_dir, "job_events"), order=("stamp", "seq")).select("job_id", "seq", "previous_status", "status")


@query
def job_snapshot(spark, sf_dir):
    s = jobs.snapshot(view(spark, sf_dir, "job_events"), at="stamp")
    return s.select("job_id", "status", "confidence_score", "retry_count", "error_message", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query
def retry_decision(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("transient", "value", "not_found", "persistent", "network", "key", "type")))
    back = F.when(F.col("status") == "extracted", "extracted").otherwise("queued")
    j = view(spark, sf_dir, "jobs").withColumn("error_kind", kinds[(F.col("o_orderkey") % 7).cast("int")]).withColumn("error", F.col("tenant_id")).withColumn("transient_status", back).drop("error_message")
    return jobs.retry_decision(j).select("job_id", "error_kind", "again", "next_status", "next_retry", "error_message")


@query
def requeue_scan(spark, sf_dir):
    return jobs.requeue(view(spark, sf_dir, "jobs"))


@query
def message_join(spark, sf_dir):
    """Messages of the output stage with their jobs: unknown ones as errors, ended ones left out."""
    j = view(spark, sf_dir, "jobs").withColumn("ground_truth", F.lit("{}"))
    messages = j.select(F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("lost-"), F.col("job_id"))).otherwise(F.col("job_id")).alias("job_id"))
    return jobs.open_messages(messages, j).select("job_id", "status", "error_kind")


@query
def message_dedupe(spark, sf_dir):
    m = view(spark, sf_dir, "job_events").select(F.concat(F.col("job_id"), F.lit("/"), F.col("status")).alias("message_id"))
    return jobs.deduplicate(m)


@query
def path_split(spark, sf_dir):
    return view(spark, sf_dir, "jobs").select("job_id", paths.split_path(F.col("input_file_path")).alias("p")).select("job_id", "p.bucket", "p.key", "p.filename")


@query
def path_build(spark, sf_dir):
    j = view(spark, sf_dir, "jobs")
    return j.select("job_id", paths.input_path(F.col("tenant_id"), F.col("job_id"), F.col("input_file_path")).alias("path"), paths.output_path(F.col("tenant_id"), F.col("job_id"), "final_output.json").alias("final_path"))


@query
def ext_filter(spark, sf_dir):
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.col("job_id"), F.lit(".TIFF"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.col("job_id"), F.lit(".v2.PNG"))).when(F.col("o_orderkey") % 4 == 2, F.col("job_id")).otherwise(F.concat(F.col("job_id"), F.lit(".jpeg")))
    j = view(spark, sf_dir, "jobs").select("job_id", name.alias("filename"))
    return j.select("job_id", "filename", paths.extension(F.col("filename")).alias("ext"), paths.is_allowed(F.col("filename")).alias("allowed"))


@query
def prompt_build(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(prompts.user_prompt(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.lit("grid"), F.col("text")).cast("binary")).alias("digest"))


@query
def final_output_json(spark, sf_dir):
    """The last JSON text of each document, read back."""
    e = evaluation.evaluate(extractions(spark, sf_dir), python_literals=False)
    job = F.concat(F.lit("job-"), F.col("o_orderkey").cast("string"))
    written = e.select(job.alias("job_id"), evaluation.final_output(job, F.lit(0.5), F.col("extraction"), F.col("evaluation")).alias("text"))
    at = lambda path: F.get_json_object("text", path)
    keys = F.array_join(F.json_object_keys("text"), ",")
    return written.select(at("$.job_id").alias("job_id"), keys.alias("keys"), at("$.ocr_confidence").cast("double").alias("confidence"), at("$.extraction.header.invoice_no").alias("invoice_no"), F.coalesce(F.json_array_length(at("$.extraction.items")), F.lit(0)).alias("n_items"), at("$.extraction.summary.total_net_worth").alias("total"), at("$.evaluation.evaluated").cast("boolean").alias("evaluated"), at("$.evaluation.passed").cast("boolean").alias("passed"), F.contains("text", F.lit('"seller" : null')).alias("nulls_written"))


def ocr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as ground truth, and a prediction with misreadings."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    misread = F.col("text")
    for right, wrong in (("the ", "teh "), ("on", "0n"), ("ll", "l")):
        misread = F.replace(misread, F.lit(right), F.lit(wrong))
    return d.select("doc_id", F.col("text").alias("truth"), misread.alias("prediction"))


@query
def cer(spark, sf_dir):
    p = ocr_pairs(spark, sf_dir)
    return p.select("doc_id", F.round(character_error_rate(F.col("prediction"), F.col("truth")), 9).alias("cer"))


@query
def wer(spark, sf_dir):
    p = ocr_pairs(spark, sf_dir)
    return p.select("doc_id", F.round(word_error_rate(F.col("prediction"), F.col("truth")), 9).alias("wer"))


@query
def cer_names(spark, sf_dir):
    """The same rates for all names of parts and clients, which SQL can follow."""
    return view(spark, sf_dir, "name_pairs").select("id", F.round(character_error_rate(F.col("prediction"), F.col("truth")), 9).alias("cer"))


@query
def wer_names(spark, sf_dir):
    return view(spark, sf_dir, "name_pairs").select("id", F.round(word_error_rate(F.col("prediction"), F.col("truth")), 9).alias("wer"))


@query
def field_exact_match(spark, sf_dir):
    i = view(spark, sf_dir, "invoices")
    truth = F.create_map(F.lit("no"), F.col("invoice_no"), F.lit("date"), F.col("gt_date"), F.lit("client"), F.concat(F.lit("  "), F.upper("client"), F.lit("  x")))
    predicted = F.create_map(F.lit("no"), F.lower("invoice_no"), F.lit("date"), F.col("invoice_date"), F.lit("client"), F.concat(F.col("client"), F.lit(" x ")))
    both = i.select("o_orderkey", fields_match(predicted, truth).alias("m"), fields_match(predicted, truth, False).alias("r"))
    return both.select("o_orderkey", *(F.col(f"m.{n}").alias(n) for n in ("no", "date", "client")), *(F.col(f"r.{n}").alias(f"raw_{n}") for n in ("no", "date", "client")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each document as text blocks in eight columns, their baselines waving."""
    words = F.split("text", r"\s+")
    box = lambda w, i: F.array((i % 8) * 120, F.floor(i / 8).cast("int") * 24 + (i % 3) * 3, (i % 8) * 120 + 8 * F.length(w), F.floor(i / 8).cast("int") * 24 + (i % 3) * 3 + 20)
    made = F.transform(words, lambda w, i: F.struct(w.alias("text"), F.lit(0.9).alias("confidence"), box(w, i).alias("bbox")))
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", 4 << 20).select("doc_id", made.alias("text_blocks"))


@query
def row_cluster(spark, sf_dir):
    r = layout.with_rows(pages(spark, sf_dir))
    return r.select("doc_id", F.size("rows").alias("n_rows"), F.array_join(F.transform("rows", lambda x: F.size(x).cast("string")), ",").alias("sizes"))


@query
def layout_text(spark, sf_dir):
    return layout.reconstruct(pages(spark, sf_dir)).select("doc_id", F.length("raw_text").alias("n_chars"), F.md5(F.col("raw_text").cast("binary")).alias("digest"))


@query
def flat_text(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", F.md5(layout.flat_text(F.col("text_blocks")).cast("binary")).alias("digest"))


@query
def tabular_row(spark, sf_dir):
    """Rows of two blocks with gaps of every width."""
    block = lambda a, b: f"named_struct('text', 'w', 'x_min', cast({a} as double), 'y_min', 0D, 'x_max', cast({b} as double), 'y_max', 20D, 'at', 0)"
    row = f"array({block('0', '50')}, {block('50 + p_partkey % 40', '150 + p_partkey % 40')})"
    return spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("r", F.expr(row)).select("p_partkey", F.expr(layout.is_tabular("r")).alias("tabular"))


@query
def region_semi_join(spark, sf_dir):
    """Rows of blocks inside a table region, by their median middle."""
    block = lambda d: f"named_struct('text', 'w', 'x_min', 0D, 'y_min', cast(p_partkey % 300 + {d} as double), 'x_max', 9D, 'y_max', cast(p_partkey % 300 + {d} + 20 as double), 'at', 0)"
    df = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("r", F.expr(f"array({block('0')}, {block('3')}, {block('7')})"))
    regions = "array(named_struct('bbox', array(0, 100, 50, 200), 'label', 'table'), named_struct('bbox', array(0, 250, 50, 290), 'label', 'figure'))"
    return df.where(F.expr(layout.in_table_region("r", regions))).select("p_partkey")


@query
def region_join(spark, sf_dir):
    """The same as a relation: rows half-joined to regions on a range."""
    at = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 300 + 13).alias("y"), F.lit("table").alias("label"))
    regions = spark.createDataFrame([("table", 95.0, 205.0), ("figure", 250.0, 290.0)], "label string, lo double, hi double")
    return at.join(regions, (at.label == regions.label) & at.y.between(regions.lo, regions.hi), "left_semi").select("p_partkey")


@query
def quad_to_box(spark, sf_dir):
    quad = F.expr("array(array(cast(p_size as double) + 0.7D, 3.2D), array(cast(p_partkey as double), 4D), array(7.9D, cast(p_size as double)), array(1.1D, -2.5D))")
    b = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", layout.box_of(quad).alias("b"))
    return b.select("p_partkey", *(F.col("b")[k].alias(n) for k, n in enumerate(("x_min", "y_min", "x_max", "y_max"))))


@query
def result_parse(spark, sf_dir):
    """Texts, scores and boxes as parallel arrays of different lengths, and the mean confidence."""
    words = F.split("p_name", " ")
    scores = F.expr("transform(sequence(1, 2), i -> cast(p_size as double) / (i * 100))")
    boxes = F.expr("array(array(0, 0, 9, 9), array(9, 0, 19, 9), array(0, 9, 9, 19))")
    b = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", layout.blocks_of_result(words, scores, boxes).alias("b"))
    return b.select("p_partkey", F.size("b").alias("n"), F.get("b", F.lit(0))["text"].alias("first"), F.round(layout.mean_confidence(F.col("b")), 6).alias("confidence"))


@query
def quality_scores(spark, sf_dir):
    s = image_quality.with_scores(view(spark, sf_dir, "image_features"))
    return s.select("p_partkey", *(F.round(c, 6).alias(c) for c in (*image_quality.WEIGHTS, "overall_score")))


@query
def source_classify(spark, sf_dir):
    return image_quality.with_source(view(spark, sf_dir, "image_features")).select("p_partkey", "source")


@query
def strategy_select(spark, sf_dir):
    return image_quality.report(view(spark, sf_dir, "image_features")).select("p_partkey", "source", "strategy")


@query
def perspective_dims(spark, sf_dir):
    point = lambda x, y: f"named_struct('x', cast({x} as double), 'y', cast({y} as double))"
    pts = F.expr(f"array({point('520', '500 + p_size')}, {point('100 + p_size', '150')}, {point('80', '450')}, {point('480', '100 + p_partkey % 13')})")
    c = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", image_quality.order_corners(pts).alias("c")).withColumn("s", image_quality.output_size(F.col("c")))
    return c.select("p_partkey", F.col("c.tl.x").alias("tl_x"), F.col("c.br.y").alias("br_y"), "s.width", "s.height")


@query
def resolution_target(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", image_quality.target_size((F.col("p_partkey") * 13 % 6000 + 100).cast("int"), (F.col("p_size") * 90 + 10).cast("int")).alias("s"))
    return p.select("p_partkey", "s.height", "s.width")


@query
def in_flight_union(spark, sf_dir):
    """Three listings put one after the other, none merged."""
    j = view(spark, sf_dir, "jobs").select("job_id", "status")
    parts = [j.where(F.col("status") == s) for s in IN_FLIGHT[:3]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
