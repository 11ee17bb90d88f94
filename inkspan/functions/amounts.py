"""Amounts as printed: currency signs, prefixes and either decimal mark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspan.functions.text import blank_if_null, let, strip

TOLERANCE = 0.05


def bare(raw: Column) -> Column:
    """Digits, marks and signs only."""
    return F.regexp_replace(raw, "[^0-9,.-]", "")


def number(kept: Column) -> Column:
    """double or null, from what bare() left; it stands in several times and should be a column. Of comma and point, the later one's kind is taken by which
    comes first; a lone comma is a decimal mark only before two final digits."""
    without = lambda c, mark: F.replace(c, F.lit(mark), F.lit(""))
    as_point = lambda c: F.replace(c, F.lit(","), F.lit("."))
    comma, point = F.instr(kept, ","), F.instr(kept, ".")
    both = F.when(comma < point, without(kept, ",")).otherwise(as_point(without(kept, ".")))
    alone = F.when(kept.rlike(",[0-9]{2}$"), as_point(kept)).otherwise(without(kept, ","))
    return F.when(comma == 0, kept).when(point > 0, both).otherwise(alone).try_cast("double")


def parse_amount(raw: Column) -> Column:
    """double or null, in one expression."""
    return let(bare(raw), number)


def close_or_same(x: Column, y: Column, a: Column, b: Column) -> Column:
    """x and y, the amounts in the texts a and b, within the tolerance; where either is no amount the texts alike, without case and outer space."""
    plain = lambda c: F.lower(strip(blank_if_null(c)))
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= TOLERANCE).otherwise(plain(a) == plain(b))


def amounts_match(a: Column, b: Column) -> Column:
    """Within the tolerance; as text, without case and outer space, where either is no amount."""
    both = F.struct(parse_amount(a).alias("x"), parse_amount(b).alias("y"))
    return let(both, lambda p: close_or_same(p["x"], p["y"], a, b))
