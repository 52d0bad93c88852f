"""Luminance at pixel grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pointwise


def to_luma(pixels: DataFrame, kind: str = "u8", weights=pointwise.LUMA) -> DataFrame:
    """One sample per pixel from as many channels as there are weights.

    A pixel with other channels raises. Samples of a pixel meet by a grouping
    with map-side maxima, and are summed in channel order, not in arrival order."""
    n = len(weights)
    each = [F.max(F.when(F.col("c") == k, F.col("v"))).alias(f"v{k}") for k in range(n)]
    wide = pixels.groupBy("image_id", "y", "x").agg(*each, F.count(F.lit(1)).alias("found"), F.max("c").alias("top"))
    ok = (F.col("found") == n) & (F.col("top") == n - 1)
    value = pointwise.luma([F.col(f"v{k}") for k in range(n)], kind, weights)
    checked = F.when(ok, value).otherwise(F.raise_error(F.lit("Number of channels and weights do not match.")).cast("double"))
    return wide.select("image_id", "y", "x", F.lit(0).alias("c"), checked.cast("float" if kind == "f32" else "int").alias("v"))
