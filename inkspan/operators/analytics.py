"""The monitoring and accuracy analytics over jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.schemas import IN_FLIGHT

PAGE = 5
STUCK_MINUTES = 10


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "status")


def evaluated(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("status") == "done") & F.col("evaluation_data").isNotNull())


def _accuracy(name: str) -> Column:
    return F.coalesce(F.col(f"evaluation_data.field_accuracies.{name}"), F.lit(0.0))


def kpi(jobs: DataFrame) -> DataFrame:
    """One row over the evaluated jobs; zeros where there are none. rating: teal from 0.7, amber from 0.4, else rose."""
    base = evaluated(jobs).agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.when(F.col("evaluation_data.passed"), 1).otherwise(0)), F.lit(0)).alias("passed_count"),
        *(F.coalesce(F.avg(_accuracy(n)), F.lit(0.0)).alias(f"avg_{n}") for n in ("invoice_no", "invoice_date", "total_net_worth")),
        F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence"),
        F.count("confidence_score").alias("n_confidence"),
    )
    rate = F.when(F.col("total") > 0, F.col("passed_count") / F.col("total")).otherwise(0.0)
    overall = (F.col("avg_invoice_no") + F.col("avg_invoice_date") + F.col("avg_total_net_worth")) / 3
    rated = base.withColumn("pass_rate", rate).withColumn("avg_overall", overall)
    return rated.withColumn("rating", F.when(F.col("pass_rate") >= 0.7, "teal").when(F.col("pass_rate") >= 0.4, "amber").otherwise("rose")).withColumn("accuracy_rating", F.when(F.col("avg_overall") >= 0.7, "teal").otherwise("amber"))


def field_accuracy(jobs: DataFrame) -> DataFrame:
    """(field, correct, total): of each mandatory field."""
    names = ("invoice_no", "invoice_date", "total_net_worth")
    wide = evaluated(jobs).agg(F.count("*").alias("total"), *(F.count_if(_accuracy(n) == 1.0).alias(n) for n in names))
    return wide.unpivot(["total"], list(names), "field", "correct").select("field", "correct", "total")


def seconds(jobs: DataFrame) -> DataFrame:
    """Adds seconds from creation to update, as a double."""
    return jobs.withColumn("seconds", F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("updated_at")) / 1e6)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, cnt): equal widths from the smallest to the largest value, which counts to the last bin. The ends are one row."""
    ends = df.where(F.col(value).isNotNull()).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).join(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins), F.width_bucket("v", F.col("lo"), F.col("hi"), F.lit(bins)))).cast("int")
    found = rows.groupBy(at.alias("bin"), "lo", "hi").agg(F.count("*").alias("cnt"))
    return found.select("bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("low"), (F.col("lo") + width * F.col("bin")).alias("high"), "cnt")


def latency_histogram(jobs: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(seconds(evaluated(jobs)).where("seconds >= 0"), "seconds", bins)


def confidence_histogram(jobs: DataFrame, bins: int = 25) -> DataFrame:
    return histogram(evaluated(jobs), "confidence_score", bins)


def stuck(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs in flight that were last updated over ten minutes before now; adds minutes."""
    late = F.timestamp_diff("MICROSECOND", F.col("updated_at"), now)
    return jobs.where(F.col("status").isin(*IN_FLIGHT) & (late > STUCK_MINUTES * 60_000_000)).withColumn("minutes", late / 60e6)


def page(df: DataFrame, number: int, order: list[Column], size: int = PAGE) -> DataFrame:
    """The rows of one page, a number beyond the ends meaning the nearest page; adds page and pages. The count is one aggregate, the page a bounded top."""
    total = df.count()
    pages = max(1, -(-total // size))
    at = min(max(number, 1), pages)
    return df.orderBy(*order).offset((at - 1) * size).limit(size).withColumn("page", F.lit(at)).withColumn("pages", F.lit(pages))


def rows_by_rank(df: DataFrame, partition: list[str], order: list[Column], first: int, last: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("rank").between(first, last))


def _percent(c: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit("%"))


def history(jobs: DataFrame) -> DataFrame:
    """The history table's texts. A confidence of 0 prints as missing."""
    s = seconds(jobs)
    return s.select(
        F.col("job_id"),
        "status",
        F.substring(F.coalesce("input_file_path", F.lit("")), 1, 40).alias("file"),
        F.when(F.col("confidence_score") != 0, _percent(F.col("confidence_score"))).otherwise("-").alias("confidence"),
        F.when(F.col("seconds") >= 0, F.concat(F.format_string("%.1f", "seconds"), F.lit("s"))).otherwise("").alias("duration"),
        F.substring(F.when(F.coalesce("error_message", F.lit("")) == "", "-").otherwise(F.col("error_message")), 1, 60).alias("error"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("created"),
    )


def details(jobs: DataFrame) -> DataFrame:
    """The evaluated jobs' table of texts."""
    mark = lambda n: F.when(_accuracy(n) == 1, "correct").otherwise("wrong").alias(n)
    return evaluated(jobs).select(
        "job_id",
        F.when(F.col("evaluation_data.passed"), "PASS").otherwise("FAIL").alias("passed"),
        mark("invoice_no"),
        mark("invoice_date"),
        mark("total_net_worth"),
        _percent(F.coalesce("confidence_score", F.lit(0.0))).alias("confidence"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.lit("-")).alias("created"),
    )
