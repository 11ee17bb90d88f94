"""Layout kernels in numpy, for Arrow UDFs: one page's blocks in, rows or text out, in time linear in the blocks but for sorting. Folds over arrays copy all that
they have gathered at every step, which is quadratic. A missing number is NaN."""

from __future__ import annotations

from heapq import heappop, heappush, heappushpop
from itertools import zip_longest

import numpy as np

#: Rows that open a section, the share of a table's height that its rows may lie above or below it, and the gap that parts two columns.
MARKERS = ("ITEMS", "SUMMARY", "TOTAL")
TABLE_MARGIN = 0.05
GAP_SHARE = 0.15
#: Mean height of a page whose blocks have none.
HEIGHT = 20.0


def _begins(middles: list[float], near: float) -> list[int]:
    """Where rows begin, one block after the other; a row's lower and upper half are heaps, so that its median is at hand."""
    begins, low, high, y = [], [], [], 0.0
    for i, m in enumerate(middles):
        if low and abs(m - y) <= near:
            heappush(high, -heappushpop(low, -m))
            if len(high) > len(low):
                heappush(low, -heappop(high))
            y = -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2
        else:
            begins.append(i)
            low, high, y = [-m], [], m
    return begins


def rows(x_min: np.ndarray, y_min: np.ndarray, y_max: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(places of the blocks, row by row from left to right; where rows begin among them, and their end). Blocks go from top to bottom; one joins the row while
    its middle is near the median of the row's middles, near being a share of the mean height of blocks that have one."""
    n = len(y_min)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    heights = (y_max - y_min)[y_max > y_min]
    near = tolerance * (np.add.accumulate(heights)[-1] / len(heights) if len(heights) else HEIGHT)
    order = np.argsort(np.where(np.isnan(y_min), -np.inf, y_min), kind="stable")
    middles = ((y_min + y_max) / 2)[order]
    # whatever the rows are, one begins at a middle that is not near the lowest one before, since no median is beyond that, and beside a missing middle
    parted = ~(middles[1:] - np.fmax.accumulate(middles)[:-1] <= near) | np.isnan(middles[:-1])
    begins = np.flatnonzero(np.concatenate(([True], parted)))
    spread = np.maximum.reduceat(middles, begins) - np.minimum.reduceat(middles, begins)
    wide = np.flatnonzero(spread > near)  # in the others each block is near any median
    if len(wide):
        ends = np.append(begins[1:], n)
        begins = np.sort(np.concatenate([begins, *(begins[k] + np.array(_begins(middles[begins[k] : ends[k]].tolist(), near)[1:], np.int64) for k in wide)]))
    row = np.repeat(np.arange(len(begins)), np.diff(begins, append=n))
    x = x_min[order]
    return order[np.lexsort((np.where(np.isnan(x), -np.inf, x), row))], np.append(begins, n)


def tabular(x_min: np.ndarray, x_max: np.ndarray, places: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each row: three blocks or more, or two with a wide gap between."""
    sizes = np.diff(begins)
    out = sizes >= 3
    two = np.flatnonzero(sizes == 2)
    a, b = places[begins[two]], places[begins[two] + 1]
    width = x_max[b] - x_min[a]
    with np.errstate(divide="ignore", invalid="ignore"):
        out[two] = (width > 0) & ((x_min[b] - x_max[a]) / width > GAP_SHARE)
    return out


def in_tables(middles: np.ndarray, places: np.ndarray, begins: np.ndarray, regions: list[dict]) -> np.ndarray:
    """Of each row: its median middle lies in a table region, with its margin."""
    out = np.zeros(len(begins) - 1, bool)
    boxes = [[np.nan if v is None else float(v) for v in r["bbox"]] for r in regions if r and r["label"] == "table" and r["bbox"] is not None]
    if boxes:
        y = np.array([np.median(middles[places[a:b]]) for a, b in zip(begins[:-1], begins[1:])])
        for box in boxes:
            margin = (box[3] - box[1]) * TABLE_MARGIN
            out |= (y >= box[1] - margin) & (y <= box[3] + margin)
    return out


def sections(cells: list[list[str]], in_columns: list[bool]) -> list[tuple[str, int, int]]:
    """(kind, first row, rows). Two tabular rows in turn open a table, from the first of them, which stays as a text row too; a marker closes an open table, but
    does not break the turn otherwise; any other row closes it."""
    out, turn, opened = [], 0, -1
    for i, (texts, is_tabular) in enumerate(zip(cells, in_columns)):
        marker = " ".join(texts).strip(" ").upper() in MARKERS
        if is_tabular and not marker:
            if opened < 0 and turn:
                opened = i - turn
            elif opened < 0:
                out.append(("text", i, 1))
            turn += 1
            continue
        if opened >= 0:
            out.append(("table", opened, i - opened))
        if opened >= 0 or not marker:
            turn = 0
        opened = -1
        out.append(("marker" if marker else "text", i, 1))
    if opened >= 0:
        out.append(("table", opened, len(cells) - opened))
    return out


def table_lines(cells: list[list[str]]) -> list[str]:
    """Padded columns with a rule below the first row."""
    widths = [max(map(len, column)) for column in zip_longest(*cells, fillvalue="")]
    shape = "| " + " | ".join(f"%-{w}s" for w in widths) + " |"
    lines = [shape % (*c, *[""] * (len(widths) - len(c))) for c in cells]
    return [lines[0], "|" + "|".join("-" * (w + 2) for w in widths) + "|", *lines[1:]]


def page_text(texts: list[str], boxes: np.ndarray, regions: list[dict] | None, tolerance: float) -> str:
    """A page's text: markers between dashes after a blank line, tables, other rows with four blanks between blocks. boxes: x_min, y_min, x_max, y_max of each."""
    x_min, y_min, x_max, y_max = boxes.T
    places, begins = rows(x_min, y_min, y_max, tolerance)
    in_columns = tabular(x_min, x_max, places, begins)
    if regions:
        in_columns |= in_tables((y_min + y_max) / 2, places, begins, regions)
    ordered, ends = [texts[p] for p in places.tolist()], begins.tolist()
    cells = [ordered[a:b] for a, b in zip(ends, ends[1:])]
    lines = []
    for kind, first, n in sections(cells, in_columns.tolist()):
        if kind == "table":
            lines += table_lines(cells[first : first + n])
        elif kind == "marker":
            lines.append(f"\n--- {' '.join(cells[first]).strip(' ').upper()} ---")
        else:
            lines.append("    ".join(cells[first]))
    return "\n".join(lines)
