"""Mixing sources to target weights (operator 9).

Every row gets a hash-random key, made from its id (from its text where that is null); the rows of a source are range-sorted by it: the key's leading
digits name one of equally wide ranges, the square root of its rows, so a source with a third of all rows is only more ranges. A key that more than HOT_KEY
rows share is ranges of its own, by size and by the staged table's partition, so that rows repeated without end are no single task's. Sums of sizes by
range give each range's offset (a prefix sum over the small table of ranges), a window inside a range gives each row's place, and the
source's budget is cut at the exact word: rows before the cut are taken whole, the row on it in part, the rest not. A target beyond the
source's size takes whole epochs first.

Targets: the sources share ``share`` times all sizes by weight; a target stops at ``cap`` times its source's size and the excess is shared
again by weight, until none is above. That is the level at which the sources below their cap get weight times one and the same
number; it is found in one sort of the sources by cap over weight. share and cap are exact fractions of up to FINEST parts; finer ones raise ValueError.

Cases: null and empty texts have size 0 and are taken 0 words; the null source is a source, the last; repeated rows have equal keys and are
placed one after the other (which of them is cut makes no difference); an empty table gives no rows; a source of size 0 has target 0;
columns named in ``keep`` pass through, others are dropped by ``mix``; ``mixture`` keeps all, whatever their names."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.common import WORD, quoted, stage

WEIGHTS = (3, 1, 2)
BROADCAST_SOURCES = 100_000
HOT_KEY = 50_000
FINEST = 1000
RESULTS = ("size", "source_size", "target", "taken")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: Column, text: Column) -> Column:
    of = F.coalesce(id_col.cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.md5(of.cast("binary"))


def _fraction(x: float) -> Fraction:
    near = Fraction(x).limit_denominator(FINEST)
    if abs(float(near) - x) > 1e-12:
        raise ValueError(f"{x} is no fraction of up to {FINEST} parts")
    return near


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sizes(source, source_size): one row a source. Adds target (double). One small table, sorted whole; share and cap are brought to one
    denominator, so that the sums stay whole numbers."""
    parts = [_fraction(share), _fraction(cap)]
    below = parts[0].denominator * parts[1].denominator
    share_n, cap_n = (int(x * below) for x in parts)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("long"))
    # by falling cap / weight, a source is capped if even the level set by it and those after it is above its cap
    fall = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    levels = weighed.select(
        "*",
        F.coalesce(F.sum("source_size").over(fall.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(fall.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_weight"),
        F.sum("source_size").over(whole).alias("total"),
    ).withColumn("rest", (share_n * exact("total") - cap_n * exact("before")).cast("decimal(38,0)"))
    capped = F.col("rest") * F.col("weight") >= cap_n * exact("source_size") * F.col("open_weight")
    first_open = F.min(F.when(~capped, F.struct((F.col("source_size") / F.col("weight")).alias("at"), F.col("before"), F.col("rest"), F.col("open_weight")))).over(whole)
    settled = levels.withColumn("capped", capped).withColumn("open", first_open)
    level = (F.col("open.rest") * F.col("weight")).cast("double") / (below * F.col("open.open_weight")).cast("double")
    return settled.select("source", "source_size", F.when(F.col("capped"), (cap_n * exact("source_size")).cast("double") / below).otherwise(level).alias("target"))


def _mixed(df: DataFrame, weights: tuple[int, ...], share: float, cap: float, id_col: str, text: str, source: str, keep: tuple[str, ...], hot: int) -> DataFrame:
    """k0, k1, ... (keep) and RESULTS."""
    of = lambda c: F.col(quoted(c))
    kept = [of(c).alias(f"k{i}") for i, c in enumerate(keep)]
    light = stage(df.select(*kept, of(id_col).alias("mix_id"), of(source).alias("source"), words_in(of(text)).alias("size"), random_key(of(id_col), of(text)).alias("key"), F.shiftright(F.monotonically_increasing_id(), 33).alias("place")))
    sums = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = targets(sums.select("source", "source_size"), weights, share, cap).join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s")))
    sources = stage(found.select("s", "n", "source_size", "target"))
    joined = light.join(F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    crowded = stage(light.groupBy(F.col("key").alias("hot_key")).agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("hot_key"))
    # the square root of a source's rows is the number of its ranges and about the number of rows in each
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.ceil(F.sqrt("n")) / (1 << 32)).cast("long")
    ranged = joined.join(crowded, F.col("key") == F.col("hot_key"), "left").withColumn("part", part)
    apart = lambda c: F.when(F.col("hot_key").isNotNull(), F.col(c)).otherwise(-1)
    ranged = ranged.withColumns({"hot_key": F.coalesce("hot_key", F.lit("")), "hot_size": apart("size"), "place": apart("place")})
    where = ["part", "hot_key", "hot_size", "place"]
    sums_by_part = ranged.groupBy("source", *where).agg(F.sum("size").alias("part_size"))
    offset = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy(*where).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stage(sums_by_part.select(F.col("source").alias("s"), *(F.col(c).alias(f"_{c}") for c in where), offset.alias("offset")))
    inside = Window.partitionBy("source", *where).orderBy("key", "mix_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("source").eqNullSafe(F.col("s"))
    for c in where:
        same = same & (F.col(c) == F.col(f"_{c}"))
    placed = ranged.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, same)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("offset") - F.col("start")))
    return placed.select(*(f"k{i}" for i in range(len(keep))), "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",), hot: int = HOT_KEY) -> DataFrame:
    """keep..., size (long), source_size (long), target (double, the source's), taken (long: words taken, repeats counted)."""
    out = _mixed(df, weights, share, cap, id_col, text, source, keep, hot)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *RESULTS)


def mixture(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", hot: int = HOT_KEY) -> DataFrame:
    """The mix itself, with df's columns: a row for each epoch in which a row is taken whole, and one with its first words, joined by one space,
    where the budget ends inside it. n_chars, if there is such a column, is counted anew."""
    names = df.columns
    mixed = _mixed(df, weights, share, cap, id_col, text, source, tuple(names), hot)
    body = F.col(f"k{names.index(text)}")
    whole = F.expr("case when size > 0 then taken div size else 0 end")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    copies = F.when(whole > 0, F.array_repeat(F.lit(0), whole.cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)
    cut = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.lit(1), F.col("cut_words")), " ")
    out = mixed.withColumn("cut_words", F.explode(parts)).withColumn("written", F.when(F.col("cut_words") > 0, cut).otherwise(body))
    own = {text: F.col("written")} | ({n_chars: F.length("written").cast("long")} if n_chars in names else {})
    return out.select(*(own.get(c, F.col(f"k{i}")).alias(c) for i, c in enumerate(names)))
