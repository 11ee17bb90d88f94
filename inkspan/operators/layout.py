"""Reconstruction of a page's layout from its text blocks: texts are stripped and repaired by expressions, rows and text come from numpy kernels in Arrow UDFs.

A block is struct(text, x_min, y_min, x_max, y_max, at), at being its place in the page, which breaks ties."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from inkspan.functions import layout_kernels as kernels
from inkspan.functions.layout_kernels import GAP_SHARE, TABLE_MARGIN
from inkspan.functions.repair import repair_text, repair_texts
from inkspan.functions.text import strip_fast

TOLERANCE = 0.5
#: Pages in an Arrow batch at most.
PAGES = 500
_REGIONS = "array<struct<label:string,bbox:array<double>>>"


def texts(text_blocks: Column, repair: bool = True) -> Column:
    """The blocks' texts, stripped and repaired; null for a block without text."""
    stripped = F.transform(F.transform(text_blocks, lambda b: strip_fast(b["text"])), lambda t: F.nullif(t, F.lit("")))
    return repair_texts(stripped) if repair else stripped


def blocks(text_blocks: Column, repair: bool = True) -> Column:
    """Blocks with text, stripped and repaired; a box of fewer than four numbers is all zeros."""
    both = F.arrays_zip(texts(text_blocks, repair).alias("text"), text_blocks["bbox"].alias("bbox"))
    named = lambda b, i: F.struct(b["text"].alias("text"), *(F.when(F.size(b["bbox"]) >= 4, F.get(b["bbox"], F.lit(k))).otherwise(0).cast("double").alias(n) for k, n in enumerate(("x_min", "y_min", "x_max", "y_max"))), i.alias("at"))
    return F.filter(F.transform(both, named), lambda b: b["text"].isNotNull())


_MIDDLE = "(b.y_min + b.y_max) / 2"


def _median(values: str) -> str:
    """Of an array of numbers that is not empty; the expression stands in once."""
    return f"element_at(transform(array(array_sort({values})), s -> (s[cast(floor((size(s) - 1) / 2) as int)] + s[cast(floor(size(s) / 2) as int)]) / 2), 1)"


def _page_ends(lists: pa.Array) -> list[int]:
    """Where pages begin among the elements of all of them, and the last one's end."""
    return [0, *np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()]


def _numbers(values: pa.Array) -> np.ndarray:
    """A null is NaN."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _few_pages(df: DataFrame) -> None:
    """Pages can be long. The session keeps the setting, since the plan that needs it runs later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= PAGES:
        df.sparkSession.conf.set(key, str(PAGES))


@cache
def _rows(tolerance: float):
    @arrow_udf("array<array<int>>")
    def rows(x_min: pa.Array, y_min: pa.Array, y_max: pa.Array) -> pa.Array:
        ends, numbers = _page_ends(x_min), [_numbers(v.flatten()) for v in (x_min, y_min, y_max)]
        pages = [kernels.rows(*(v[a:b] for v in numbers), tolerance) for a, b in zip(ends, ends[1:])]
        begins = np.concatenate([[0], *(begins[1:] + a for (_, begins), a in zip(pages, ends))])
        each = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(np.concatenate([p for p, _ in pages]), pa.int32()))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(begins) - 1 for _, begins in pages)]), pa.int32()), each)

    return rows


def _corners(boxes: pa.Array) -> np.ndarray:
    """The first four numbers of each box; a box of fewer is all zeros."""
    sizes, numbers = pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False), _numbers(boxes.flatten())
    if (sizes == 4).all():
        return numbers.reshape(-1, 4)
    out, whole = np.zeros((len(boxes), 4)), sizes >= 4
    out[whole] = numbers[(np.cumsum(sizes) - sizes)[whole][:, None] + np.arange(4)]
    return out


@cache
def _text(tolerance: float):
    @arrow_udf("string")
    def text(texts: pa.Array, boxes: pa.Array, regions: pa.Array) -> pa.Array:
        ends, each, box, out = _page_ends(texts), texts.flatten(), boxes.flatten(), []
        for page, (a, b) in enumerate(zip(ends, ends[1:])):
            there = each[a:b].is_valid().to_numpy(zero_copy_only=False)
            out.append(kernels.page_text(each[a:b].to_numpy(zero_copy_only=False)[there].tolist(), _corners(box[a:b])[there], regions[page].as_py(), tolerance))
        return pa.array(out, pa.string())

    return text


def is_tabular(row: str) -> str:
    """SQL: three blocks or more, or two with a wide gap between."""
    gap, width = f"({row}[1].x_min - {row}[0].x_max)", f"({row}[1].x_max - {row}[0].x_min)"
    return f"(size({row}) >= 3 or (size({row}) = 2 and {width} > 0 and {gap} / nullif({width}, 0) > {GAP_SHARE}D))"


def in_table_region(row: str, regions: str) -> str:
    """SQL: the row's median middle lies in a table region, with its margin."""
    y = _median(f"transform({row}, b -> {_MIDDLE})")
    margin = f"(t.bbox[3] - t.bbox[1]) * {TABLE_MARGIN}D"
    return f"exists(transform(filter({regions}, t -> t.label = 'table'), t -> named_struct('lo', t.bbox[1] - {margin}, 'hi', t.bbox[3] + {margin})), t -> {y} between t.lo and t.hi)"


def with_rows(df: DataFrame, text_blocks: str = "text_blocks", repair: bool = True, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds rows: array of rows, each an array of blocks from left to right."""
    _few_pages(df)
    placed = df.withColumn("blocks", blocks(F.col(text_blocks), repair)).withColumn("_rows", _rows(tolerance)("blocks.x_min", "blocks.y_min", "blocks.y_max"))
    return placed.withColumn("rows", F.expr("if(blocks is null, null, transform(_rows, r -> transform(r, p -> blocks[p])))")).drop("blocks", "_rows")


def reconstruct(df: DataFrame, text_blocks: str = "text_blocks", regions: str | None = None, repair: bool = True, tolerance: float = TOLERANCE, out: str = "raw_text") -> DataFrame:
    """Adds the page's text; empty for a page without blocks."""
    _few_pages(df)
    tables = F.expr(f"transform({regions}, t -> named_struct('label', t.label, 'bbox', cast(t.bbox as array<double>)))") if regions else F.lit(None).cast(_REGIONS)
    return df.withColumn(out, _text(tolerance)(texts(F.col(text_blocks), repair), F.col(text_blocks)["bbox"], tables))


def flat_text(text_blocks: Column, repair: bool = True) -> Column:
    """Without layout: the blocks' texts as they come, one a line."""
    return F.array_join(F.transform(text_blocks, lambda b: repair_text(b["text"]) if repair else b["text"]), "\n")


def box_of(quad: Column) -> Column:
    """array<array<double>> of four points to [x_min, y_min, x_max, y_max], cut to whole numbers."""
    side = lambda k, f: f(F.transform(quad, lambda p: p[k])).cast("int")
    return F.array(side(0, F.array_min), side(1, F.array_min), side(0, F.array_max), side(1, F.array_max))


def blocks_of_result(texts: Column, scores: Column, boxes: Column) -> Column:
    """Parallel arrays to text blocks, as many as the shortest has."""
    n = F.least(F.size(texts), F.size(scores), F.size(boxes))
    return F.transform(F.slice(F.arrays_zip(texts.alias("text"), scores.alias("confidence"), boxes.alias("bbox")), F.lit(1), n), lambda b: F.struct(b["text"].alias("text"), b["confidence"].cast("double").alias("confidence"), b["bbox"].cast("array<int>").alias("bbox")))


def blocks_of_lines(raw: Column) -> Column:
    """The older form of a result, JSON of pages of lines, a line being four points, then text and confidence: the first page's text blocks."""
    pages = F.from_json(raw, "array<array<array<string>>>")
    line = lambda x: F.from_json(x[1], "array<string>")
    block = lambda x: F.struct(line(x)[0].alias("text"), line(x)[1].cast("double").alias("confidence"), box_of(F.from_json(x[0], "array<array<double>>")).alias("bbox"))
    first = F.get(pages, F.lit(0))
    return F.when(F.size(first) > 0, F.transform(first, block)).otherwise(F.array().cast("array<struct<text:string,confidence:double,bbox:array<int>>>"))


def mean_confidence(text_blocks: Column) -> Column:
    return F.when(F.size(text_blocks) > 0, F.aggregate(text_blocks, F.lit(0.0), lambda s, b: s + b["confidence"]) / F.size(text_blocks)).otherwise(0.0)
