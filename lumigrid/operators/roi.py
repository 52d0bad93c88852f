"""Regions of interest at pixel grain: a filter and a shift, and zeros where the region leaves the image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _filled(pixels: DataFrame, dims: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = (F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)
    moved = pixels.where(inside).select("image_id", (F.col("y") - y).alias("y"), (F.col("x") - x).alias("x"), "c", "v")
    # only places outside the source are made, from the dimensions, without a join
    rows, cols = F.greatest(F.col("height") - y, F.lit(0)), F.greatest(F.col("width") - x, F.lit(0))
    short = dims.where((rows < height) | (cols < width))
    places = short.select("image_id", "channels", rows.alias("rows"), cols.alias("cols"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    places = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x")).where("y >= rows or x >= cols")
    blank = places.select("image_id", "y", "x", F.explode(F.sequence(F.lit(0), F.col("channels").cast("int") - 1)).alias("c"), F.lit(0).cast(pixels.schema["v"].dataType).alias("v"))
    return moved.unionByName(blank)


def select_roi(pixels: DataFrame, dims: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """A region of the stated size from (x, y). dims: image_id, width, height, channels.

    An origin outside an image raises, for that image's rows."""
    if width < 1 or height < 1 or x < 0 or y < 0:
        raise ValueError("ROI needs a positive size.")
    ok = (F.col("width") > x) & (F.col("height") > y)
    checked = dims.withColumn("width", F.when(ok, F.col("width")).otherwise(F.raise_error(F.lit("ROI is out of bounds.")).cast("int")))
    return _filled(pixels, checked, x, y, width, height)


def copy_to(pixels: DataFrame, dims: DataFrame, width: int, height: int, x: int, y: int) -> DataFrame:
    """A zeroed image of the stated size with the part of each source from (x, y) at its origin; no overlap leaves zeros."""
    return _filled(pixels, dims, x, y, width, height)
