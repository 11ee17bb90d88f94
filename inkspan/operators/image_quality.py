"""Image quality: features of pixel tables, scores, classification of the source and choice of the preprocessing, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources in the order in which ties are settled, strategies, and thresholds.
SOURCES = ("software_pdf", "scanner", "camera_clean", "camera_degraded")
STRATEGIES = ("none", "minimal", "moderate", "aggressive")
SHARP, DYNAMIC_RANGE, BRIGHT, SNR, BACKGROUND_STD = 500.0, 200.0, (120.0, 220.0), 25.0, 50.0
#: Weights of the scores in the overall one.
WEIGHTS = {"sharpness_score": 0.30, "contrast_score": 0.20, "brightness_score": 0.15, "noise_score": 0.20, "bg_uniformity": 0.15}
#: Points that a feature's range gives to the sources, first range that fits.
POINTS = (
    (("edge_density > 0.08", {"software_pdf": 2.0}), ("edge_density > 0.05", {"software_pdf": 1.0, "scanner": 0.5}), ("true", {"camera_clean": 0.5, "camera_degraded": 0.5})),
    (("bg_std < 5 and bg_mean > 230", {"software_pdf": 2.0}), ("bg_std < 10 and bg_mean > 200", {"software_pdf": 1.0, "scanner": 1.5}), ("bg_std < 15", {"scanner": 0.5, "camera_clean": 1.0}), ("true", {"camera_degraded": 1.5})),
    (("sharpness > 500", {"software_pdf": 1.0, "scanner": 0.5}), ("sharpness > 200", {"scanner": 1.0, "camera_clean": 0.5}), ("sharpness < 100", {"camera_degraded": 2.0})),
    (("noise_snr > 30", {"software_pdf": 0.5, "scanner": 0.5}), ("noise_snr < 15", {"camera_degraded": 1.5})),
    (("contrast < 100", {"camera_degraded": 1.0}),),
)


def with_scores(df: DataFrame) -> DataFrame:
    """From sharpness, contrast, brightness, noise_snr and bg_std to scores from 0 to 1, and overall_score."""
    lo, hi = BRIGHT
    b = F.col("brightness")
    off = F.least(F.abs(b - lo), F.abs(b - hi))
    scored = df.withColumns({
        "sharpness_score": F.least(F.col("sharpness") / SHARP, F.lit(1.0)),
        "contrast_score": F.least(F.col("contrast") / DYNAMIC_RANGE, F.lit(1.0)),
        "brightness_score": F.when(b.between(lo, hi), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - off / 100)),
        "noise_score": F.least(F.col("noise_snr") / SNR, F.lit(1.0)),
        "bg_uniformity": F.greatest(F.lit(0.0), 1 - F.col("bg_std") / BACKGROUND_STD),
    })
    overall = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("overall_score", overall)


def with_source(df: DataFrame) -> DataFrame:
    """Adds source: the one with most points, the first of those that tie."""
    totals = {}
    for s in SOURCES:
        total = F.lit(0.0)
        for ranges in POINTS:
            part = F.lit(0.0)
            for condition, points in reversed(ranges):
                part = F.when(F.expr(condition), points.get(s, 0.0)).otherwise(part)
            total = total + part
        totals[f"_{s}"] = total
    best = F.greatest(*(F.col(f"_{s}") for s in SOURCES))
    source = F.coalesce(*(F.when(F.col(f"_{s}") == best, s) for s in SOURCES))
    return df.withColumns(totals).withColumn("source", source).drop(*totals)


def with_strategy(df: DataFrame) -> DataFrame:
    """Adds strategy, from source and the scores of sharpness and noise."""
    clear = lambda x: (F.col("sharpness_score") > x) & (F.col("noise_score") > x)
    by = F.when(F.col("source") == "software_pdf", F.when(clear(0.8), "none").otherwise("minimal"))
    by = by.when(F.col("source") == "scanner", F.when(clear(0.7), "minimal").otherwise("moderate"))
    return df.withColumn("strategy", by.when(F.col("source") == "camera_clean", "moderate").otherwise("aggressive"))


def report(df: DataFrame) -> DataFrame:
    return with_strategy(with_source(with_scores(df)))


def from_pixels(pixels: DataFrame, key: str, corner_part: int = 10, least_corner: int = 5) -> DataFrame:
    """pixels(key, y, x, v): sharpness (variance of the Laplacian, edges mirrored), contrast (95th less 5th percentile), brightness, bg_std and
    bg_mean (of the four corners, a corner being a corner_part of the shorter side; 0 and the mean where that is under least_corner). One shuffle, by
    picture."""
    sheet = pixels.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v")))).alias("p"),
        (F.max("y") + 1).alias("h"),
        (F.max("x") + 1).alias("w"),
        (F.percentile("v", 0.95) - F.percentile("v", 0.05)).alias("contrast"),
        F.avg("v").alias("brightness"),
    )
    near = lambda i, n: f"case when {i} < 0 then -({i}) when {i} >= {n} then 2 * ({n} - 1) - ({i}) else {i} end"
    at = lambda y, x: f"p[cast(({near(y, 'h')}) * w + ({near(x, 'w')}) as int)].v"
    edge = f"transform(p, c -> {at('c.y - 1', 'c.x')} + {at('c.y + 1', 'c.x')} + {at('c.y', 'c.x - 1')} + {at('c.y', 'c.x + 1')} - 4 * c.v)"
    mean = lambda a: f"aggregate({a}, 0D, (s, v) -> s + v) / size({a})"
    spread = lambda a: f"aggregate({a}, 0D, (s, v) -> s + v * v) / size({a}) - power({mean(a)}, 2)"
    out = sheet.withColumn("l", F.expr(edge)).withColumn("sharpness", F.expr(spread("l"))).withColumn("k", F.floor(F.least("h", "w") / corner_part).cast("int"))
    corners = [("y < k", "x < k"), ("y < k", "x >= w - k"), ("y >= h - k", "x < k"), ("y >= h - k", "x >= w - k")]
    for i, (a, b) in enumerate(corners):
        y, x = a.replace("y", "c.y"), b.replace("x", "c.x")
        out = out.withColumn(f"c{i}", F.expr(f"transform(filter(p, c -> {y} and {x}), c -> c.v)"))
    small = F.col("k") < least_corner
    std = F.expr(" + ".join(f"sqrt(greatest(0D, {spread(f'c{i}')}))" for i in range(4))) / 4
    middle = F.expr(" + ".join(mean(f"c{i}") for i in range(4))) / 4
    return out.select(key, "sharpness", "contrast", "brightness", F.when(small, 0.0).otherwise(std).alias("bg_std"), F.when(small, F.col("brightness")).otherwise(middle).alias("bg_mean"))


def order_corners(points: Column) -> Column:
    """array<struct<x,y>> of four points to struct(tl, tr, br, bl): least and greatest x + y, least and greatest y - x; the first of those that tie."""
    key = lambda sign, what, i: F.struct((sign * what).alias("v"), i.alias("i"))

    def pick(sign: int, what) -> Column:
        ranked = F.transform(points, lambda p, i: F.struct(key(F.lit(sign), what(p), i).alias("k"), p.alias("p")))
        return F.array_min(ranked)["p"]

    total, turn = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.struct(pick(1, total).alias("tl"), pick(1, turn).alias("tr"), pick(-1, total).alias("br"), pick(-1, turn).alias("bl"))


def output_size(corners: Column) -> Column:
    """struct(width, height): the longer of opposite sides, cut to whole numbers."""
    side = lambda a, b: F.sqrt(F.pow(corners[a]["x"] - corners[b]["x"], 2) + F.pow(corners[a]["y"] - corners[b]["y"], 2))
    return F.struct(F.greatest(side("tr", "tl"), side("br", "bl")).cast("int").alias("width"), F.greatest(side("bl", "tl"), side("br", "tr")).cast("int").alias("height"))


def target_size(height: Column, width: Column, least: int = 2000, most: int = 4000) -> Column:
    """struct(height, width) after resolution is normalised: the long side at least and at most so many pixels."""
    long = F.greatest(height, width)
    scale = F.when(long < least, F.lit(float(least)) / long).when(long > most, F.lit(float(most)) / long).otherwise(1.0)
    return F.struct((height * scale).cast("int").alias("height"), (width * scale).cast("int").alias("width"))
