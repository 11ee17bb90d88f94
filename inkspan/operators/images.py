"""Pictures in columns of bytes: features, quality report, preprocessing. Kernels run in Arrow batches; scores, source and strategy are native."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from inkspan.functions import image_kernels as kernels
from inkspan.operators.image_quality import report

FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("sharpness", "contrast", "brightness", "noise_snr", "edge_density", "bg_std", "bg_mean")])


@pandas_udf(FEATURES)
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for data in batches:
        found = [kernels.decode_png(x) for x in data]
        yield pd.DataFrame([kernels.features(x[0]) if x else dict.fromkeys(FEATURES.names) for x in found], columns=FEATURES.names)


def enhanced(raw: bytes | None, strategy: str | None) -> bytes | None:
    """A picture after the strategy's steps, its text chunks kept; what cannot be decoded, or has no strategy, as it is."""
    image = kernels.decode_png(raw) if strategy else None
    return kernels.encode_png(kernels.preprocess(image[0], strategy), image[1]) if image else raw


@pandas_udf(T.BinaryType())
def _preprocessed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, strategies in batches:
        yield pd.Series([enhanced(raw, strategy) for raw, strategy in zip(data, strategies, strict=True)])


def assess(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds the features, scores, source and strategy of each picture; null where it cannot be decoded."""
    with_features = df.withColumn("_f", _features(F.col(content)))
    flat = with_features.select(*df.columns, *(F.col(f"_f.{n}").alias(n) for n in FEATURES.names))
    known = F.col("sharpness").isNotNull()
    done = report(flat)
    return done.withColumns({c: F.when(known, F.col(c)) for c in ("source", "strategy")})


def preprocess(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds processed (bytes): the picture enhanced by its strategy; what cannot be decoded stays as it is."""
    return assess(df, content).withColumn("processed", _preprocessed(F.col(content), F.col("strategy")))
