"""Invoice numbers: letters and digits only, without case; one may hold the other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import blank_if_null, let


def normalise_number(c: Column) -> Column:
    return F.lower(F.regexp_replace(blank_if_null(c), "[^a-zA-Z0-9]", ""))


def numbers_match(a: Column, b: Column) -> Column:
    pair = F.struct(normalise_number(a).alias("x"), normalise_number(b).alias("y"))
    return let(pair, lambda p: F.when((p["x"] == "") | (p["y"] == ""), p["x"] == p["y"]).otherwise(F.contains(p["x"], p["y"]) | F.contains(p["y"], p["x"])))
