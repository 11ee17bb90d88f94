"""Dates as printed: numeric in six orders, or with English month names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import blank_if_null, let, squash, strip, with_step

#: Month names; a name stands for itself and for its first three letters.
MONTHS = "january february march april may june july august september october november december".split()
#: Numeric orders, in order of preference; Y has four digits, y two (69 to 99 are 1969 to 1999).
ORDERS = ("Ymd", "dmY", "mdY", "ymd", "dmy", "mdy")


def _day(y: Column, m: Column, d: Column) -> Column:
    """date, or null if there is no such day or the year is 0."""
    year = y.try_cast("int")
    return F.when(year > 0, F.try_make_timestamp(year, m.try_cast("int"), F.trim(d).try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def parts_of(clean: Column) -> Column:
    return F.split(F.regexp_replace(clean, "[./]", "-"), "-")


def numeric_day(p: Column) -> Column:
    """date or null, from the parts between marks."""
    short = lambda c: c.rlike("^(?:[0-9]{1,2}| [1-9])$")
    tries = []
    for order in ORDERS:
        at = {x: F.get(p, F.lit(k)) for k, x in enumerate(order.lower())}
        y = at["y"]
        fits = y.rlike("^[0-9]{4}$" if "Y" in order else "^[0-9]{2}$") & short(at["d"]) & at["m"].rlike("^[0-9]{1,2}$")
        year = y if "Y" in order else F.concat(F.when(y >= "69", "19").otherwise("20"), y)
        tries.append(F.when(fits, _day(year, at["m"], at["d"])))
    return F.when(F.size(p) == 3, F.coalesce(*tries))


#: Patterns of dates with a month's name, and which of their groups are month and day; the third is the year.
NAMED = ((r"^([A-Za-z]+) ([0-9]{1,2}), ([0-9]{4})$", 1, 2), (r"^([0-9]{1,2}) ([A-Za-z]+) ([0-9]{4})$", 2, 1))


def month_of(clean: Column, pattern: str, month: int) -> Column:
    names = F.array(*map(F.lit, MONTHS), *(F.lit(m[:3]) for m in MONTHS))
    return F.array_position(names, F.lower(F.regexp_extract(clean, pattern, month)))


def named_day(clean: Column, at: Column, pattern: str, day: int) -> Column:
    """date or null; at: what month_of() says."""
    return F.when(at > 0, _day(F.regexp_extract(clean, pattern, 3), (at - 1) % 12 + 1, F.regexp_extract(clean, pattern, day)))


def parse_date(raw: Column) -> Column:
    """date or null, in one expression."""

    def named(clean: Column, pattern: str, month: int, day: int) -> Column:
        return let(month_of(clean, pattern, month), lambda at: named_day(clean, at, pattern, day))

    def either(clean: Column) -> Column:
        return F.coalesce(let(parts_of(clean), numeric_day), *(named(clean, *n) for n in NAMED))

    return let(squash(raw), either)


def with_days(df: DataFrame, days: dict[str, str]) -> DataFrame:
    """df with the dates in its text columns: each new column by the one it is read from. Every step is a column of its own, worked out once."""
    clean = {f"_clean_{k}": squash(F.col(v)) for k, v in days.items()}
    steps = {f"_parts_{k}": parts_of(F.col(f"_clean_{k}")) for k in days} | {f"_month{i}_{k}": month_of(F.col(f"_clean_{k}"), p, m) for k in days for i, (p, m, _) in enumerate(NAMED)}
    found = {k: F.coalesce(numeric_day(F.col(f"_parts_{k}")), *(named_day(F.col(f"_clean_{k}"), F.col(f"_month{i}_{k}"), p, d) for i, (p, _, d) in enumerate(NAMED))) for k in days}
    return with_step(with_step(with_step(df, clean), steps), found).drop(*clean, *steps)


def same_day(x: Column, y: Column, a: Column, b: Column) -> Column:
    """x and y, the dates in the texts a and b: the same day, or day and month in turn where both could be either; else whether the texts are alike."""
    plain = lambda c: F.lower(strip(blank_if_null(c)))
    turned = (F.year(x) == F.year(y)) & (F.day(x) == F.month(y)) & (F.month(x) == F.day(y))  # so both are 12 or less
    return F.coalesce((x == y) | turned, F.lit(False)) | (plain(a) == plain(b))


def dates_match(a: Column, b: Column) -> Column:
    return let(F.struct(parse_date(a).alias("x"), parse_date(b).alias("y")), lambda p: same_day(p["x"], p["y"], a, b))
