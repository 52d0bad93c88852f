"""Synthetic frames for timing: one sample per row, or one image per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import pointwise
from ..images import ImageFrame
from ..operators import luma
from ..schema import IMAGE, RGB, ColorSpace, bayer


def _cast(spark, _):
    """1 Mi samples of 16 bits to 8 bits."""
    return spark.range(1 << 20).select(pointwise.cast_u8(F.pmod(F.xxhash64("id"), F.lit(65536)).cast("int"), "u16").alias("v"))


def _floor(spark, _):
    return spark.range(1 << 20).select(pointwise.floor_u8((F.pmod(F.xxhash64("id"), F.lit(65536)) / 65535.0).cast("float"), "f32").alias("v"))


def images(spark, side: int, count: int, space: ColorSpace):
    """``count`` random 16-bit images of ``side`` x ``side``."""

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                a = np.random.default_rng(i).integers(0, 65536, side * side * space.channels).astype("<u2")
                row = {"image_id": i, "width": side, "height": side, "channels": space.channels, "cspace": {"kind": space.kind, "pattern": space.pattern, "channels": space.channels, "name": None}, "pixel_type": "u16", "data": a.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    return ImageFrame(spark.range(count).mapInArrow(run, IMAGE))


_SCHEMA = pa.schema([
    ("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()),
    ("cspace", pa.struct([("kind", pa.string()), ("pattern", pa.string()), ("channels", pa.int16()), ("name", pa.string())])),
    ("pixel_type", pa.string()), ("data", pa.binary()),
])
WEIGHTS = (0.2126, 0.7152, 0.0722)


def _luma(side: int):
    return lambda spark, _: images(spark, side, 8, RGB).to_luma(WEIGHTS).df.select("image_id", F.crc32("data"))


def _debayer(method: str):
    return lambda spark, _: images(spark, 1024, 8, bayer("RGGB")).debayer(method).df.select("image_id", F.crc32("data"))


def _luma_rows(spark, _):
    """A pixel-grain frame of 512 x 512 x 3."""
    rows = spark.range(512 * 512 * 3).selectExpr("0L AS image_id", "CAST(id DIV 1536 AS INT) AS y", "CAST(id DIV 3 % 512 AS INT) AS x", "CAST(id % 3 AS INT) AS c", "CAST(pmod(xxhash64(id), 65536) AS INT) AS v")
    return luma.to_luma(rows, "u16", WEIGHTS)


CASES = {"cast_u8_1mi": _cast, "floor_u8_f32_1mi": _floor, "luma_rows_512": _luma_rows}
CASES |= {f"luma_8x{n}": _luma(n) for n in (3072, 1024, 512, 256, 128, 64)}
CASES |= {f"debayer_{m}_8x1024": _debayer(m) for m in ("none", "nearest", "linear", "cubic")}
