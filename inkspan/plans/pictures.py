"""Queries on pictures: encoded ones are made from keys, and the kernels run on their bytes. The SQL beside each works on the pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from inkspan.functions import image_kernels as kernels
from inkspan.operators import images
from inkspan.plans.catalogue import query
from inkspan.plans.derived import sql

SIDE = 16


def _grid(key: int) -> np.ndarray:
    """A background of one level and a darker pattern."""
    k = np.arange(SIDE * SIDE)
    return np.where((key + k) % 7 == 0, (key * 31 + k * 17) % 256, 200 + key % 50).astype(np.uint8).reshape(SIDE, SIDE)


def _coloured(key: int) -> np.ndarray:
    k = np.arange(SIDE * SIDE)
    return (np.stack([key + k, key * 3 + k * 5, k * 7], axis=1) % 32 * 8).astype(np.uint8).reshape(SIDE, SIDE, 3)


def _page(key: int) -> np.ndarray:
    """A white page of a size of its own, with dark bars for lines."""
    page = np.full((40 + key * 3, 60 + key * 200), 255, np.uint8)
    for y in range(8, len(page) - 8, 8):
        page[y : y + 3, 10:-10] = np.where(np.arange(page.shape[1] - 20) % 7 < 4, 20, 255)
    return page


def slope(key: int) -> int:
    return (key % 5 - 2) * 5


def _sloping(key: int) -> np.ndarray:
    page = np.full((240, 400), 255, np.uint8)
    x = np.arange(30, 370)
    for y in (80, 120, 160):
        at = np.rint(y + np.tan(np.radians(slope(key))) * (x - 200)).astype(int)
        page[at, x] = page[at + 1, x] = page[at + 2, x] = 0
    return page


def _quad(key: int) -> np.ndarray:
    return np.array([[100 + key, 150], [480, 100 + key], [520, 500], [80, 450]], float)


def _tilted(key: int) -> np.ndarray:
    """A white sheet, seen from aside, on black."""
    y, x = np.mgrid[:600, :600]
    inside = np.ones((600, 600), bool)
    quad = _quad(key)
    for a, b in zip(quad, np.roll(quad, -1, axis=0), strict=True):
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
    return np.where(inside, 255, 0).astype(np.uint8)


def _encoded(drawn: Callable[[int], np.ndarray]):
    @pandas_udf("binary")
    def encode(keys: pd.Series) -> pd.Series:
        return pd.Series([kernels.encode_png(drawn(int(k))) for k in keys])

    return encode


def pictures(spark: SparkSession, sf_dir: str, drawn: Callable[[int], np.ndarray] = _grid, table: str = "part", key: str = "p_partkey") -> DataFrame:
    """(key, content): a PNG of each row."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, _encoded(drawn)(F.col(key)).alias("content"))


def _measured(kernel: Callable[[np.ndarray], tuple], schema: str):
    """A column of a kernel's numbers for each encoded picture."""
    names = [x.split()[0] for x in schema.split(", ")]

    @pandas_udf(schema)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for data in batches:
            yield pd.DataFrame([kernel(kernels.decode_png(x)[0]) for x in data], columns=names)

    return measure


def _sums(g: np.ndarray) -> tuple[int, int]:
    """Of the levels, and of the levels each times its place."""
    flat = g.astype(np.int64).ravel()
    return int(flat.sum()), int(flat @ np.arange(1, len(flat) + 1))


def _of_levels(spark: SparkSession, sf_dir: str, step: Callable[[np.ndarray], np.ndarray], drawn=_grid) -> DataFrame:
    found = pictures(spark, sf_dir, drawn).select("p_partkey", _measured(lambda image: _sums(step(image)), "total long, placed long")("content").alias("m"))
    return found.select("p_partkey", "m.total", "m.placed")


@query
def image_assess(spark, sf_dir):
    a = images.assess(pictures(spark, sf_dir))
    return a.select("p_partkey", *(F.round(c, 4).alias(c) for c in ("sharpness", "contrast", "brightness", "noise_snr", "edge_density")), "source", "strategy")


@query
def image_sharpness(spark, sf_dir):
    return images.assess(pictures(spark, sf_dir)).select("p_partkey", F.round("sharpness", 4).alias("sharpness"))


@query
def image_contrast(spark, sf_dir):
    return images.assess(pictures(spark, sf_dir)).select("p_partkey", F.round("contrast", 6).alias("contrast"), F.round("brightness", 6).alias("brightness"))


@query
def bg_uniformity(spark, sf_dir):
    """Corners of a third of the side, since these pictures are small."""
    background = _measured(lambda image: kernels.background(kernels.grey(image), 3), "bg_std double, bg_mean double")
    return pictures(spark, sf_dir).select("p_partkey", background("content").alias("b")).select("p_partkey", F.round("b.bg_std", 4).alias("bg_std"), F.round("b.bg_mean", 6).alias("bg_mean"))


@query
def image_grey(spark, sf_dir):
    return _of_levels(spark, sf_dir, kernels.grey, _coloured)


@query
def image_sharpen(spark, sf_dir):
    return _of_levels(spark, sf_dir, lambda image: kernels.sharpen(kernels.grey(image)))


@query
def image_smooth(spark, sf_dir):
    return _of_levels(spark, sf_dir, lambda image: kernels.smooth(kernels.grey(image)))


@query
def image_rotate(spark, sf_dir):
    """A quarter turn."""
    return _of_levels(spark, sf_dir, lambda image: kernels.rotate(kernels.grey(image), 90))


@query
def image_preprocess(spark, sf_dir):
    """Pages of all sizes through the whole enhancement: their sizes after it."""
    done = images.preprocess(pictures(spark, sf_dir, _page, "nation", "n_nationkey")).withColumn("content", F.col("processed"))
    return done.select("n_nationkey", _measured(lambda image: image.shape[:2], "height int, width int")("content").alias("s")).select("n_nationkey", "s.height", "s.width")


@query
def image_skew(spark, sf_dir):
    """Slopes of drawn lines, to the nearest step of five degrees."""
    skew = _measured(lambda image: (kernels.skew(kernels.grey(image)),), "degrees double")
    return pictures(spark, sf_dir, _sloping, "nation", "n_nationkey").select("n_nationkey", (F.round(skew("content")["degrees"] / 5) * 5).cast("int").alias("degrees"))


def _straightened(image: np.ndarray) -> tuple[bool, bool, bool]:
    out = kernels.straighten(kernels.grey(image))
    return out.shape != image.shape[:2], bool(out[len(out) // 2, out.shape[1] // 2] > 200), bool((out > 200).mean() > 0.9)


@query
def image_perspective(spark, sf_dir):
    """Sheets seen from aside: whether an outline was found, and whether what is left is all sheet."""
    done = pictures(spark, sf_dir, _tilted, "nation", "n_nationkey").select("n_nationkey", _measured(_straightened, "found boolean, centre boolean, sheet boolean")("content").alias("s"))
    return done.select("n_nationkey", "s.found", "s.centre", "s.sheet")


# SQL


_PIXELS = f"""WITH pixels AS ({sql('pixels', True)}), a AS (SELECT p_partkey, list(v ORDER BY y, x) AS p FROM pixels GROUP BY p_partkey),
i AS (SELECT p_partkey, p, unnest(range({SIDE * SIDE})) AS k FROM a),
c AS (SELECT p_partkey, p, k, k // {SIDE} AS y, k % {SIDE} AS x, p[k + 1] AS v FROM i)"""


def _mirrored(dy: int, dx: int) -> str:
    """The level beside a pixel; edges mirrored without the edge pixel."""
    last = SIDE - 1
    near = lambda c, d: {0: c, -1: f"(CASE WHEN {c} = 0 THEN 1 ELSE {c} - 1 END)", 1: f"(CASE WHEN {c} = {last} THEN {last - 1} ELSE {c} + 1 END)"}[d]
    return f"p[({near('y', dy)} * {SIDE} + {near('x', dx)} + 1)::INT]"


def _folded(weights: list[list[float]]) -> str:
    return "(" + " + ".join(f"{w} * {_mirrored(i - 1, j - 1)}" for i, row in enumerate(weights) for j, w in enumerate(row) if w) + ")"


def _beside(dy: int, dx: int) -> str:
    """The size of the gradient beside a pixel; none beyond the edge."""
    inside = f"y + {dy} BETWEEN 0 AND {SIDE - 1} AND x + {dx} BETWEEN 0 AND {SIDE - 1}"
    return f"CASE WHEN {inside} THEN s[((y + {dy}) * {SIDE} + x + {dx} + 1)::INT] ELSE 0 END"


_FEATURES = f"""{_PIXELS},
laplace AS (SELECT p_partkey, var_pop({_folded([[0, 1, 0], [1, -4, 1], [0, 1, 0]])}) AS sharpness, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS contrast, avg(v)::DOUBLE AS brightness, stddev_pop(v) AS spread FROM c GROUP BY p_partkey),
around AS (SELECT p_partkey, k, v, unnest([p[(least({SIDE - 1}, greatest(0, y + d // 5 - 2)) * {SIDE} + least({SIDE - 1}, greatest(0, x + d % 5 - 2)) + 1)::INT] FOR d IN range(25)]) AS n FROM c),
middle AS (SELECT p_partkey, k, v - median(n) AS noise FROM around GROUP BY p_partkey, k, v),
noise AS (SELECT p_partkey, stddev_pop(noise) AS noise FROM middle GROUP BY p_partkey),
g AS (SELECT p_partkey, k, y, x, {_folded([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])} AS gx, {_folded([[-1, -2, -1], [0, 0, 0], [1, 2, 1]])} AS gy FROM c),
l AS (SELECT p_partkey, list(abs(gx) + abs(gy) ORDER BY k) AS s FROM g GROUP BY p_partkey),
n AS (SELECT g.*, abs(gx) + abs(gy) AS size, abs(gy) < 0.414 * abs(gx) AS flat, abs(gy) > 2.414 * abs(gx) AS steep, gx * gy > 0 AS same, s FROM g JOIN l USING (p_partkey)),
t AS (SELECT p_partkey, y, x, size FROM n WHERE size > 50 AND size > CASE WHEN flat THEN {_beside(0, -1)} WHEN steep THEN {_beside(-1, 0)} WHEN same THEN {_beside(-1, -1)} ELSE {_beside(-1, 1)} END
  AND size >= CASE WHEN flat THEN {_beside(0, 1)} WHEN steep THEN {_beside(1, 0)} WHEN same THEN {_beside(1, 1)} ELSE {_beside(1, -1)} END),
strong AS (SELECT p_partkey, y, x FROM t WHERE size > 150 UNION SELECT t.p_partkey, t.y, t.x FROM strong r JOIN t ON t.p_partkey = r.p_partkey AND abs(t.y - r.y) <= 1 AND abs(t.x - r.x) <= 1),
dense AS (SELECT p_partkey, count(*)::DOUBLE / {SIDE * SIDE} AS edge_density FROM strong GROUP BY p_partkey),
image_features AS (SELECT p_partkey, sharpness, contrast, brightness, CASE WHEN noise < 1e-6 THEN 100.0 ELSE spread / noise END AS noise_snr, coalesce(edge_density, 0) AS edge_density, 0.0 AS bg_std, brightness AS bg_mean
  FROM laplace JOIN noise USING (p_partkey) LEFT JOIN dense USING (p_partkey))"""


def _levels(value: str, source: str = _PIXELS) -> str:
    return f"{source}, o AS (SELECT p_partkey, k, ({value})::BIGINT AS o FROM c) SELECT p_partkey, sum(o)::BIGINT AS total, sum(o * (k + 1))::BIGINT AS placed FROM o GROUP BY p_partkey"


def oracle_sql(scores: str, source: str) -> dict[str, str]:
    """scores, source: the SQL of the scoring and classification, over image_features."""
    strategy = "CASE source WHEN 'software_pdf' THEN CASE WHEN sharpness_score > 0.8 AND noise_score > 0.8 THEN 'none' ELSE 'minimal' END WHEN 'scanner' THEN CASE WHEN sharpness_score > 0.7 AND noise_score > 0.7 THEN 'minimal' ELSE 'moderate' END WHEN 'camera_clean' THEN 'moderate' ELSE 'aggressive' END"
    rounded = ", ".join(f"round({x}, 4) AS {x}" for x in ("sharpness", "contrast", "brightness", "noise_snr", "edge_density"))
    coloured = f"WITH c AS (SELECT p_partkey, k, (p_partkey + k) % 32 * 8 AS b, (p_partkey * 3 + k * 5) % 32 * 8 AS g, (k * 7) % 32 * 8 AS r FROM part, (SELECT unnest(range({SIDE * SIDE})) AS k))"
    scale = "CASE WHEN greatest(h, w) < 2000 THEN 2000::DOUBLE / greatest(h, w) WHEN greatest(h, w) > 4000 THEN 4000::DOUBLE / greatest(h, w) ELSE 1 END"
    clip = lambda x: f"least(255, greatest(0, round_even({x}, 0)))"
    return {
        "image_assess": f"{_FEATURES.replace('WITH pixels', 'WITH RECURSIVE pixels')}, {scores}, {source} SELECT p_partkey, {rounded}, source, {strategy} AS strategy FROM named",
        "image_grey": _levels("round(0.114 * b + 0.587 * g + 0.299 * r)", coloured),
        "image_sharpen": _levels(clip(_folded([[0, -0.5, 0], [-0.5, 3, -0.5], [0, -0.5, 0]]) + "::DOUBLE")),
        "image_smooth": _levels(clip(_folded([[1, 2, 1], [2, 4, 2], [1, 2, 1]]) + "::DOUBLE / 16")),
        "image_rotate": _levels(f"CASE WHEN y = 0 THEN 255 ELSE p[(x * {SIDE} + {SIDE} - y + 1)::INT] END"),
        "image_preprocess": f"WITH s AS (SELECT n_nationkey, 40 + n_nationkey * 3 AS h, 60 + n_nationkey * 200 AS w FROM nation), z AS (SELECT *, {scale} AS f FROM s) SELECT n_nationkey, trunc(h * f)::INT AS height, trunc(w * f)::INT AS width FROM z",
        "image_skew": "SELECT n_nationkey, ((n_nationkey % 5 - 2) * 5)::INT AS degrees FROM nation",
        "image_perspective": "SELECT n_nationkey, true AS found, true AS centre, true AS sheet FROM nation",
    }
