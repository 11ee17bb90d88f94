"""Validation of extractions, and scoring against ground truth of any shape."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from inkspan.functions.amounts import TOLERANCE, bare, close_or_same, number, parse_amount
from inkspan.functions.dates import same_day, with_days
from inkspan.functions.invoice_numbers import numbers_match
from inkspan.functions.text import has_text, let, strip, with_step
from inkspan.schemas import EXTRACTION, REQUIRED

#: JSON texts that count as nothing.
NOTHING = ("null", "{}", "[]", '""', "0", "0.0", "-0.0", "false")
#: The fields that are compared, and the part of an extraction that holds each.
FIELDS = {"invoice_no": "header", "invoice_date": "header", "total_net_worth": "summary"}


def parse_extraction(raw: Column) -> Column:
    """struct(value, valid): the extraction in a JSON text, and whether it is JSON of the schema with all that is required."""
    with_bad = EXTRACTION.jsonValue()
    schema = type(EXTRACTION).fromJson({**with_bad, "fields": [*with_bad["fields"], {"name": "_bad", "type": "string", "nullable": True, "metadata": {}}]})

    def judge(read: Column) -> Column:
        value = F.struct(*(read[f.name].alias(f.name) for f in EXTRACTION.fields))
        there = read["_bad"].isNull() & read["items"].isNotNull() & F.forall(read["items"], lambda x: x["item_desc"].isNotNull())
        for path in REQUIRED:
            part, name = path.split(".")
            there = there & read[part][name].isNotNull()
        return F.struct(value.alias("value"), F.coalesce(there, F.lit(False)).alias("valid"))

    return let(F.from_json(raw, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}), judge)


def is_valid(extraction: Column) -> Column:
    """The mandatory fields hold text."""
    return has_text(extraction["header"]["invoice_no"]) & has_text(extraction["header"]["invoice_date"]) & has_text(extraction["summary"]["total_net_worth"])


def items_sum(items: Column) -> Column:
    """Sum of the items' net worths; null if none is an amount."""
    amounts = F.filter(F.transform(items, lambda x: parse_amount(x["item_net_worth"])), lambda a: a.isNotNull())
    return let(amounts, lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, a: s + a)))


def items_sum_differs(extraction: Column) -> Column:
    """A warning, not a failure: the items' net worths do not add up to the total."""
    off = F.abs(items_sum(extraction["items"]) - parse_amount(extraction["summary"]["total_net_worth"])) > TOLERANCE
    return F.coalesce(off, F.lit(False))


@pandas_udf(T.StringType())
def _python_literal(texts: pd.Series) -> pd.Series:
    def read(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(ast.literal_eval(text), default=str)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return texts.map(read)


def _counts(text: Column) -> Column:
    """Whether a JSON text says anything."""
    return F.coalesce(~text.isin(*NOTHING), F.lit(False))


def _kind(text: Column, mark: str) -> Column:
    """Whether a JSON text is of the kind that begins with the mark."""
    return F.coalesce(text.startswith(mark), F.lit(False))


def with_truth(df: DataFrame, ground_truth: str = "ground_truth", python_literals: bool = True) -> DataFrame:
    """Adds truth (variant: the data to compare with, or null if there is none to be read), truth_text (that as JSON) and has_truth (boolean: anything was given). The
    ground truth is JSON text; its data may stand under the key json, itself as a text in JSON or, with python_literals, as a Python literal. Each step is
    a column of its own: a variant is read, and written out, once."""
    out = df.withColumn("_outer", F.try_parse_json(ground_truth))
    out = with_step(out, {"_outer_text": F.to_json("_outer"), "_json": F.try_variant_get("_outer", "$.json", "variant")})
    out = out.withColumn("_json_text", F.to_json("_json")).withColumn("_quoted", _kind(F.col("_json_text"), '"'))
    out = out.withColumn("_said", F.when(F.col("_quoted"), F.try_variant_get("_json", "$", "string"))).withColumn("_inner", F.try_parse_json("_said"))
    if python_literals:
        out = out.withColumn("_inner", F.coalesce("_inner", F.try_parse_json(_python_literal(F.when(F.col("_inner").isNull(), F.col("_said"))))))
    out = out.withColumn("_inner_text", F.to_json("_inner"))
    counts, whole = _counts(F.col("_json_text")), _kind(F.col("_json_text"), "{")
    pick = lambda inner, json_, outer: F.when(counts, F.when(F.col("_quoted"), F.col(inner)).when(whole, F.col(json_))).when(_kind(F.col("_outer_text"), "{"), F.col(outer))
    out = out.withColumns({"truth": pick("_inner", "_json", "_outer"), "truth_text": pick("_inner_text", "_json_text", "_outer_text"), "has_truth": _counts(F.col("_outer_text"))})
    there = _counts(F.col("truth_text"))
    out = with_step(out, {"truth_text": F.when(there, F.col("truth_text")), "truth": F.when(there, F.col("truth"))})
    return out.drop("_outer", "_json", "_outer_text", "_json_text", "_quoted", "_said", "_inner", "_inner_text")


def evaluate(df: DataFrame, extraction: str = "extraction", ground_truth: str = "ground_truth", python_literals: bool = True) -> DataFrame:
    """Adds evaluation (evaluated, passed, field_accuracies) and evaluation_error (transient, with no verdict, where the ground truth is a list
    or a scalar; null otherwise). Without ground truth everything passes unevaluated; ground truth without header or summary passes;
    what cannot be read fails."""
    out, own, truth = with_truth(df, ground_truth, python_literals), F.col(extraction), F.col("truth")
    given = {p: F.try_variant_get(truth, f"$.{p}", "variant").isNotNull() for p in ("header", "summary")}
    out = out.withColumn("_whole", given["header"] & given["summary"])
    of = lambda kind: {f"_{kind}_{n}": F.try_variant_get(truth, f"$.{part}.{n}", kind) for n, part in FIELDS.items()}
    out = with_step(out, of("string") | of("variant"))
    want = {f"_want_{n}": F.coalesce(strip(F.when(_counts(F.to_json(f"_variant_{n}")), F.col(f"_string_{n}"))), F.lit("")) for n in FIELDS}
    have = {f"_have_{n}": strip(F.coalesce(own[part][n], F.lit(""))) for n, part in FIELDS.items()}
    out = with_step(out, want | have)
    sides = ("have", "want")
    texts = {n: [F.col(f"_{s}_{n}") for s in sides] for n in FIELDS}
    out = with_days(with_step(out, {f"_bare_{s}": bare(F.col(f"_{s}_total_net_worth")) for s in sides}), {f"_day_{s}": f"_{s}_invoice_date" for s in sides})
    out = with_step(out, {f"_number_{s}": number(F.col(f"_bare_{s}")) for s in sides})
    both = lambda name: [F.col(f"_{name}_{s}") for s in sides]
    same = {
        "invoice_no": numbers_match(*texts["invoice_no"]),
        "invoice_date": same_day(*both("day"), *texts["invoice_date"]),
        "total_net_worth": close_or_same(*both("number"), *texts["total_net_worth"]),
    }
    fits = {f"_{n}": F.when(F.col("_whole"), (texts[n][1] == "") | same[n]).otherwise(truth.isNotNull() | ~F.col("has_truth")) for n in FIELDS}
    odd = truth.isNotNull() & ~_kind(F.col("truth_text"), "{") & F.col("has_truth")
    out = with_step(out, fits | {"_odd": odd})
    marks = F.struct(*(F.when(~F.col("_odd"), F.col(f"_{n}").cast("double")).alias(n) for n in FIELDS))
    passed = F.when(~F.col("_odd"), F.col("_invoice_no") & F.col("_invoice_date") & F.col("_total_net_worth"))
    # never null as a whole, so that a filter on it is not pushed down as all of the above
    verdict = F.struct(F.col("has_truth").alias("evaluated"), passed.alias("passed"), marks.alias("field_accuracies"))
    done = out.withColumns({"evaluation": verdict, "evaluation_error": F.when(F.col("_odd"), "transient")})
    return done.select(*df.columns, "evaluation", "evaluation_error")


def final_output(job_id: Column, confidence: Column, extraction: Column, evaluation: Column) -> Column:
    """The document's last JSON text, indented, nulls written."""
    record = F.struct(job_id.alias("job_id"), confidence.alias("ocr_confidence"), extraction.alias("extraction"), evaluation.alias("evaluation"))
    return F.to_json(record, {"pretty": "true", "ignoreNullFields": "false"})
