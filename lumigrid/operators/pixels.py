"""Between image and pixel grain, and neighbourhoods of pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PIXEL_TYPES


def from_arrays(df: DataFrame, pix: str, width: Column, height: Column, channels: int = 1) -> DataFrame:
    """Pixel rows of an array column; surplus elements are left out."""
    out = df.select("image_id", width.alias("w"), height.alias("h"), F.posexplode(pix).alias("p", "v"))
    out = out.where(F.col("p") < F.col("w") * F.col("h") * channels)
    spot = F.floor(F.col("p") / channels).cast("int")
    return out.select("image_id", F.floor(spot / F.col("w")).cast("int").alias("y"), (spot % F.col("w")).cast("int").alias("x"), (F.col("p") % channels).cast("int").alias("c"), "v")


def to_pixels(images: DataFrame, kind: str) -> DataFrame:
    """Pixel rows of image rows of one pixel type, decoded in Arrow batches."""
    value = {"f32": ("float", pa.float32()), "f64": ("double", pa.float64()), "u32": ("bigint", pa.int64())}.get(kind, ("int", pa.int32()))

    def run(batches):
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            for i, w, ch, data in zip(*(col(n).to_pylist() for n in ("image_id", "width", "channels")), col("data"), strict=True):
                a = np.frombuffer(data.as_buffer(), PIXEL_TYPES[kind][0])  # in place
                for lo in range(0, len(a), 1 << 16):
                    p = np.arange(lo, min(lo + (1 << 16), len(a)))
                    spot = p // ch
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), i, np.int64)), pa.array((spot // w).astype(np.int32)), pa.array((spot % w).astype(np.int32)), pa.array((p % ch).astype(np.int32)), pa.array(a[p]).cast(value[1])],
                        names=["image_id", "y", "x", "c", "v"],
                    )

    return images.where(F.col("pixel_type") == kind).select("image_id", "width", "channels", "data").mapInArrow(run, f"image_id bigint, y int, x int, c int, v {value[0]}")


def to_arrays(pixels: DataFrame) -> DataFrame:
    """One row per image: its samples in order. For images that fit in a row."""
    packed = F.array_sort(F.collect_list(F.struct("y", "x", "c", "v")))
    return pixels.groupBy("image_id").agg(packed.alias("p")).select("image_id", F.transform("p", lambda s: s["v"]).alias("pix"))


def reflected(at: Column, by: int, size: Column) -> Column:
    """Offset from ``at`` to the place ``by`` steps away, reflected at both borders without repeating the edge."""
    there = F.abs(at + by)
    return F.when(there > size - 1, 2 * (size - 1) - there).otherwise(there) - at


def neighbourhood(mosaic: DataFrame, reach: int) -> DataFrame:
    """Adds ``near``: (2 reach + 1) rows of as many values around each pixel.

    mosaic: image_id, y, x, v, w, h and others. Rows are windows of (image, y),
    columns of (image, x): tasks get lines, never a whole image."""
    span = range(-reach, reach + 1)

    def gather(value: str, at: str, size: str, window) -> Column:
        moved = [F.col(value) if d == 0 else F.lag(value, -d).over(window) if d < 0 else F.lead(value, d).over(window) for d in span]
        return F.array(*moved)

    def pick(values: Column, at: str, size: str) -> Column:
        return F.array(*[F.get(values, (reflected(F.col(at), d, F.col(size)) + reach).cast("int")) for d in span])

    line = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")
    out = mosaic.withColumn("raw", gather("v", "x", "w", line)).withColumn("line", pick(F.col("raw"), "x", "w")).drop("raw")
    return out.withColumn("raw", gather("line", "y", "h", column)).withColumn("near", pick(F.col("raw"), "y", "h")).drop("raw", "line")


BORDERS = ("none", "mirror", "replicate")


def bordered(mosaic: DataFrame, padding: int, how: str) -> DataFrame:
    """Lines of a mosaic with ``padding`` more samples at both ends: x from -padding.

    ``mirror`` reflects without repeating the edge, ``replicate`` repeats the two
    samples at the edge, so both keep the mosaic's pattern; ``none`` adds nothing.
    mosaic: image_id, y, x, v, w. Each sample emits its copies, so nothing is shuffled."""
    if how not in BORDERS:
        raise ValueError(f"Unknown border {how}")
    if how == "none" or not padding:
        return mosaic.select("image_id", "y", "x", "v")
    x, last = F.col("x"), F.col("w") - 1
    if how == "mirror":
        # x is shown again at -x and, from the other end, at 2 * last - x
        places = F.filter(F.array(-x, 2 * last - x), lambda j: ((j < 0) & (j >= -padding)) | ((j > last) & (j <= last + padding)))
    else:
        steps = F.sequence(F.lit(1), F.lit(padding))
        before = F.when(x < 2, F.filter(F.transform(steps, lambda k: -k), lambda j: F.pmod(j, F.lit(2)) == x))
        after = F.when(x > last - 2, F.filter(F.transform(steps, lambda k: last + k), lambda j: F.pmod(j - last - 1, F.lit(2)) == x - last + 1))
        none = F.array().cast("array<int>")
        places = F.concat(F.coalesce(before, none), F.coalesce(after, none))
    return mosaic.select("image_id", "y", F.explode(F.concat(F.array(x), places)).alias("x"), "v")
