"""File names and object paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of documents that are taken in.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "webp")
BUCKET = "invoices"


def extension(filename: Column) -> Column:
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1))).otherwise("")


def is_allowed(filename: Column) -> Column:
    return F.coalesce(extension(filename).isin(*EXTENSIONS), F.lit(False))


def input_path(tenant: Column, job: Column, filename: Column, bucket: str = BUCKET) -> Column:
    return F.concat_ws("/", F.lit(bucket), tenant, job, F.concat(F.lit("input."), extension(filename)))


def split_path(path: Column) -> Column:
    """struct(bucket, key, filename); null where there is no slash."""
    parts = F.split(path, "/", 2)
    found = F.struct(parts[0].alias("bucket"), F.get(parts, F.lit(1)).alias("key"), F.substring_index(path, "/", -1).alias("filename"))
    return F.when(F.contains(path, F.lit("/")), found)


def output_path(tenant: Column, job: Column, name: str) -> Column:
    return F.concat_ws("/", tenant, job, F.lit(name))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), F.lit(False))
