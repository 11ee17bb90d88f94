"""White space as Unicode sees it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: Every character that \s matches in (?U).
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip_fast(c: Column) -> Column:
    """The same as strip, without a pattern: for many short texts."""
    return F.btrim(c, F.lit(SPACES))


def squash(c: Column) -> Column:
    """Runs of white space as one blank, ends stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def has_text(c: Column) -> Column:
    return blank_if_null(strip(c)) != ""


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a plain Column used twice is written out, and run, twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_step(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns, for a step of many long expressions. Whole-stage code would put all of them into one method, which the JVM does not compile beyond 8,000
    bytes of code; a bound value keeps the step out of it, and its expressions get methods of their own."""
    first = next(iter(columns))
    return df.withColumns({**columns, first: let(columns[first], lambda x: x)})
