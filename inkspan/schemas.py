"""Schemas of the nested records, and the job state machine."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str, required: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), n not in required) for n in names])


#: The fields of the records, and which of them must be there.
HEADER = _strings("invoice_no", "invoice_date", "seller", "client", "seller_tax_id", "client_tax_id", "iban")
ITEM = _strings("item_desc", "item_qty", "item_net_price", "item_net_worth", "item_vat", "item_gross_worth")
SUMMARY = _strings("total_net_worth", "total_vat", "total_gross_worth")
EXTRACTION = T.StructType([T.StructField("header", HEADER), T.StructField("items", T.ArrayType(ITEM)), T.StructField("summary", SUMMARY)])
#: Fields that an extraction must have, by path.
REQUIRED = ("header.invoice_no", "header.invoice_date", "summary.total_net_worth")
TEXT_BLOCK = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("bbox", T.ArrayType(T.IntegerType()))])
REGION = T.StructType([T.StructField("bbox", T.ArrayType(T.IntegerType())), T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())])
OCR_OUTPUT = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("ocr_engine", T.StringType()), T.StructField("raw_text", T.StringType()), T.StructField("average_confidence", T.DoubleType()), T.StructField("text_blocks", T.ArrayType(TEXT_BLOCK))])
ACCURACIES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("invoice_no", "invoice_date", "total_net_worth")])
EVALUATION = T.StructType([T.StructField("evaluated", T.BooleanType()), T.StructField("passed", T.BooleanType()), T.StructField("field_accuracies", ACCURACIES)])
TENANT = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("config", T.StringType()), T.StructField("rate_limit", T.IntegerType())])
JOB_EVENT = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("tenant_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("input_file_path", T.StringType()), T.StructField("retry_count", T.IntegerType()), T.StructField("confidence_score", T.DoubleType()), T.StructField("ground_truth", T.StringType()), T.StructField("evaluation_data", EVALUATION), T.StructField("error_message", T.StringType())])
#: What travels from intake to processing, and from processing to output.
INGESTED = _strings("job_id", "tenant_id", "input_file_path").add("retry_count", T.IntegerType())
EXTRACTED = _strings("job_id", "tenant_id", "ocr_output_path").add("ocr_confidence", T.DoubleType()).add("extraction_data", T.StringType()).add("retry_count", T.IntegerType())

#: The statuses of a job, those in flight, those that end it, and which may follow which.
STATUSES = ("queued", "ocr_processing", "ocr_done", "extracting", "extracted", "validating", "done", "failed")
IN_FLIGHT = ("queued", "ocr_processing", "extracting", "validating", "ocr_done", "extracted")
TERMINAL = ("done", "failed")
TRANSITIONS = {
    "queued": ("ocr_processing", "failed"),
    "ocr_processing": ("ocr_done", "queued", "failed"),
    "ocr_done": ("extracting", "ocr_processing", "failed"),
    "extracting": ("extracted", "queued", "ocr_processing", "failed"),
    "extracted": ("validating", "done", "ocr_processing", "failed"),
    "validating": ("done", "failed"),
    "done": (),
    "failed": (),
}
