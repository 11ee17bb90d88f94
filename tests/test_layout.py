"""Layout kernels against plain versions and the column forms, and pages of many blocks."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from inkspan.functions import layout_kernels as kernels
from inkspan.functions.repair import repair_text, repair_texts
from inkspan.functions.text import SPACES, strip, strip_fast
from inkspan.operators import layout

WORDS = ("items", "TOTAL", " Summary ", "items �", "�", "", "  ", None, "1O5", "3l4", "VAT 120Z", "1200Z", "20Z", "1   2", "Grossworth", "O1,5", "漢字😀", "a\0 b", "wide words here")
BLOCK = "struct<text:string,confidence:double,bbox:array<int>>"
TABLE = "array<struct<label:string,bbox:array<int>>>"


def plain_rows(boxes, ratio):
    heights = [b[3] - b[1] for b in boxes if b[3] > b[1]]
    near, out, y = ratio * (sum(heights) / len(heights) if heights else 20), [], 0.0
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i][1]):
        middle = (boxes[i][1] + boxes[i][3]) / 2
        if out and abs(middle - y) <= near:
            out[-1].append(i)
            y = float(np.median([(boxes[k][1] + boxes[k][3]) / 2 for k in out[-1]]))
        else:
            out.append([i])
            y = middle
    return [sorted(r, key=lambda i: boxes[i][0]) for r in out]


def plain_tabular(row, boxes, regions):
    y = float(np.median([(boxes[i][1] + boxes[i][3]) / 2 for i in row]))
    for box in (box for label, box in regions if label == "table"):
        margin = (box[3] - box[1]) * 0.05
        if box[1] - margin <= y <= box[3] + margin:
            return True
    if len(row) != 2:
        return len(row) > 2
    a, b = boxes[row[0]], boxes[row[1]]
    return b[2] > a[0] and (b[0] - a[2]) / (b[2] - a[0]) > 0.15


def plain_text(texts, boxes, regions=(), ratio=0.5):
    lines, rows, turn, start = [], plain_rows(boxes, ratio), 0, None

    def close(end):
        cells = [[texts[i] for i in r] for r in rows[start:end]]
        cells = [c + [""] * (max(map(len, cells)) - len(c)) for c in cells]
        widths = [max(len(c[j]) for c in cells) for j in range(len(cells[0]))]
        table = ["| " + " | ".join(x.ljust(w) for x, w in zip(c, widths)) + " |" for c in cells]
        lines.extend([table[0], "|" + "|".join("-" * (w + 2) for w in widths) + "|", *table[1:]])

    for i, row in enumerate(rows):
        said = " ".join(texts[k] for k in row).strip().upper()
        if said in ("ITEMS", "SUMMARY", "TOTAL"):
            if start is not None:
                close(i)
                start, turn = None, 0
            lines.append(f"\n--- {said} ---")
            continue
        if plain_tabular(row, boxes, regions):
            turn += 1
            if turn >= 2 and start is None:
                start = i - turn + 1
        else:
            if start is not None:
                close(i)
            start, turn = None, 0
        if start is None:
            lines.append("    ".join(texts[k] for k in row))
    if start is not None:
        close(len(rows))
    return "\n".join(lines)


def box(rng, kind):
    """Loose boxes, boxes in lines and columns, and boxes of which some are very tall."""
    x, y = rng.randint(0, 300), rng.randint(0, 400)
    if kind == 0:
        return [x, y % 60, rng.randint(0, 400), y % 60 + rng.randint(0, 30)]
    if kind == 1:
        return [x % 5 * 100, (y := y % 9 * 25 + rng.randint(0, 4)), x % 5 * 100 + 50, y + 20]
    return [x, y, rng.randint(0, 400), y + rng.choice([10, 12, 300])]


def test_text_like_plain():
    rng = random.Random(11)
    for n in range(600):
        boxes = [box(rng, n % 3) for _ in range(rng.choice([1, 2, 3, 8, 30, 90]))]
        texts = [rng.choice(["items", "TOTAL", "a", "bcd", "漢字😀", "two words"]) for _ in boxes]
        regions = rng.choice([[], [("table", [0, 50, 9, 150])], [("figure", [0, 0, 9, 500]), ("table", [0, 10, 9, 30])]])
        ratio = rng.choice([0.1, 0.5, 2.0])
        assert kernels.page_text(texts, np.array(boxes, float), [{"label": k, "bbox": b} for k, b in regions], ratio) == plain_text(texts, boxes, regions, ratio)


def test_rows_like_column_forms(spark):
    rng = random.Random(12)
    pages = [(i, [("w", 0.9, box(rng, i % 3)) for _ in range(rng.randint(1, 20))]) for i in range(60)]
    regions = "array(named_struct('bbox', array(0, 20, 50, 45), 'label', 'table'), named_struct('bbox', array(0, 100, 50, 250), 'label', 'table'), named_struct('bbox', array(0, 0, 50, 900), 'label', 'figure'))"
    done = layout.with_rows(spark.createDataFrame(pages, f"i int, text_blocks array<{BLOCK}>"))
    got = done.select("i", F.expr(f"transform(rows, r -> {layout.is_tabular('r')})").alias("tabular"), F.expr(f"transform(rows, r -> {layout.in_table_region('r', regions)})").alias("inside")).collect()
    for r in got:
        x_min, y_min, x_max, y_max = np.array([b for _, _, b in pages[r.i][1]], float).T
        places, begins = kernels.rows(x_min, y_min, y_max, layout.TOLERANCE)
        assert kernels.tabular(x_min, x_max, places, begins).tolist() == r.tabular
        tables = [{"label": "table", "bbox": [0, 20, 50, 45]}, {"label": "table", "bbox": [0, 100, 50, 250]}, {"label": "figure", "bbox": [0, 0, 50, 900]}]
        assert kernels.in_tables((y_min + y_max) / 2, places, begins, tables).tolist() == r.inside


def test_odd_blocks(spark):
    rows = [
        (1, [("b", 0.9, [50, None, 60, 20]), ("a", 0.9, [0, 0, 9, 20]), (None, 0.9, [0, 0, 1, 1]), None, ("c", 0.9, [None, 0, 60, 20]), ("d", 0.9, [5, 0])], None),
        (2, [("�", 0.9, [0, 0, 9, 20]), ("  ", 0.9, [10, 0, 19, 20]), ("5O5", 0.9, [30, 0, 39, 20])], [(None, None), ("table", None), ("table", [0, None, 1, 9])]),
        (3, None, None),
    ]
    df = spark.createDataFrame(rows, f"i int, text_blocks array<{BLOCK}>, regions {TABLE}")
    for regions in (None, "regions"):
        got = {r.i: r.raw_text for r in layout.reconstruct(df, regions=regions).collect()}
        # b's middle is not known, so that it stands alone; a box of two numbers is all zeros, half a height above; a lost character leaves an empty block
        assert got == {1: "b\nc    a    d", 2: "    505", 3: ""}
    assert [r.rows for r in layout.with_rows(df).where("i = 3").collect()] == [None]


def test_long_pages(spark):
    """Folds over arrays took 25 s for 40,000 blocks, and four times that for twice as many."""
    n = 60_000
    upright = f"transform(sequence(0, {n - 1}), i -> named_struct('text', concat('w', i), 'confidence', 0.9D, 'bbox', array(i % 4 * 100, {{y}}, i % 4 * 100 + 50, {{y}} + 20)))"
    for y, lines in (("cast(i div 4 as int) * 30", 15_002), ("0", 1), ("cast(i div 8 as int)", None)):  # lines of four, one line, one slant
        began = time.perf_counter()
        text = layout.reconstruct(spark.range(1).select(F.expr(upright.format(y=y)).alias("text_blocks"))).first().raw_text
        assert time.perf_counter() - began < 15
        assert lines is None or text.count("\n") + 1 == lines
        assert {w for w in text.split() if w.startswith("w")} == {f"w{i}" for i in range(n)}


def test_texts_at_once(spark):
    rng = random.Random(13)
    pages = [(i, [rng.choice(WORDS + tuple("10OlZ .,\0")) for _ in range(rng.randint(0, 4))]) for i in range(300)]
    pages += [(300 + k, [w]) for k, w in enumerate((*WORDS, "5O5", "O5,5", "7l7", "90Z", "9  9", "networth", "Netprice", "٣O٤", "9\xa0\xa09"))]
    pages += [(1000, None)]
    df = spark.createDataFrame(pages, "i int, t array<string>")
    assert df.where(~repair_texts(F.col("t")).eqNullSafe(F.transform("t", repair_text))).count() == 0
    chars = spark.createDataFrame([(chr(c) + "x y" + chr(c),) for c in range(0x10000) if not 0xD800 <= c < 0xE000], "t string")
    assert chars.where(~strip("t").eqNullSafe(strip_fast("t"))).count() == 0
    assert chars.where(strip_fast("t") == "x y").count() == len(SPACES)
