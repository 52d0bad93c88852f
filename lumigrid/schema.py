"""The two shapes that images take in DataFrames, and the rules of construction.

Image grain, one row an image: ``image_id, width, height, channels, cspace,
pixel_type, data`` and optionally ``metadata``; ``data`` holds little-endian
pixels, row by row, channels together. Pixel grain, one row a sample:
``image_id, y, x, c, v``, with one row of dimensions per image beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = {"string": T.StringType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "u64": T.DecimalType(20, 0)}


def struct(text: str) -> T.StructType:
    """A schema of plain types, without a session."""
    return T.StructType([T.StructField(n, _PLAIN[t]) for n, t in (x.split() for x in text.split(", "))])


CSPACE = struct("kind string, pattern string, channels smallint, name string")
META_VALUE = struct("kind string, i bigint, u u64, f double, s string, ns bigint, comment string")
METADATA = T.MapType(T.StringType(), META_VALUE)
IMAGE = struct("image_id bigint, width int, height int, channels int").add("cspace", CSPACE).add("pixel_type", T.StringType()).add("data", T.BinaryType())

#: fixed values: name, storage, least and greatest value, tag in the wire format
PIXEL_TYPES = {
    "u8": ("<u1", 0, 255, 8),
    "u16": ("<u2", 0, 65535, 16),
    "u32": ("<u4", 0, 4294967295, 32),
    "i8": ("<i1", -128, 127, -8),
    "i16": ("<i2", -32768, 32767, -16),
    "i32": ("<i4", -2147483648, 2147483647, -128),
    "f32": ("<f4", 0.0, 1.0, -32),
    "f64": ("<f8", 0.0, 1.0, -64),
}
#: those that a type-erased image can hold
DYNAMIC = ("u8", "u16", "f32")
PATTERNS = ("BGGR", "GBRG", "GRBG", "RGGB")
MAX_SIDE = 65535


#: fixed values: how the kinds without a pattern are called
NO_CFA = {"gray": "Gray", "rgb": "RGB", "custom": "Custom"}


@dataclass(frozen=True)
class ColorSpace:
    kind: str
    pattern: str | None = None
    channels: int = 1
    name: str | None = None

    @property
    def is_bayer(self) -> bool:
        return self.kind == "bayer"

    def column(self) -> Column:
        return F.struct(
            F.lit(self.kind).alias("kind"), F.lit(self.pattern).cast("string").alias("pattern"),
            F.lit(self.channels).cast("smallint").alias("channels"), F.lit(self.name).cast("string").alias("name"),
        )

    @staticmethod
    def of(row) -> ColorSpace:
        return ColorSpace(row["kind"], row["pattern"], row["channels"], row["name"])

    def cfa(self) -> str:
        """The mosaic's pattern; a colour space without one says so."""
        if not self.is_bayer:
            raise ValueError(f"{NO_CFA[self.kind]} color space not supported in Bayer images.")
        return self.pattern

    def text(self) -> str:
        if self.kind == "custom":
            return f"C({self.channels}, {self.name})"
        return self.pattern if self.is_bayer else self.kind.upper()


GRAY, RGB = ColorSpace("gray"), ColorSpace("rgb", channels=3)


def bayer(pattern: str) -> ColorSpace:
    if pattern.upper() not in PATTERNS:
        raise ValueError(f"Unknown Bayer pattern {pattern}")
    return ColorSpace("bayer", pattern.upper())


def custom(channels: int, name: str) -> ColorSpace:
    return ColorSpace("custom", channels=channels, name=name)


def cspace_text(cspace: Column) -> Column:
    """GRAY, RGB, a pattern, or C(channels, name)."""
    return (
        F.when(cspace["kind"] == "bayer", cspace["pattern"])
        .when(cspace["kind"] == "custom", F.format_string("C(%d, %s)", cspace["channels"].cast("int"), cspace["name"]))
        .otherwise(F.upper(cspace["kind"]))
    )


def construction_error(width: Column, height: Column, channels: Column, elements: Column) -> Column:
    """The first rule that an image breaks, or null. Surplus data is no error."""
    need = width.cast("decimal(20,0)") * height.cast("decimal(20,0)") * channels.cast("decimal(6,0)")
    return (
        F.when((width > MAX_SIDE) | (height > MAX_SIDE), "Image too large.")
        .when(F.coalesce(elements, F.lit(0)) == 0, "Data is empty")
        .when(width == 0, "Width is zero")
        .when(height == 0, "Height is zero")
        .when(channels == 0, "Image has no channels.")
        .when(need > elements, "Not enough data for image.")
    )


def element_bytes(pixel_type: Column) -> Column:
    sizes = [F.lit(x) for k, v in PIXEL_TYPES.items() for x in (k, np.dtype(v[0]).itemsize)]
    return F.try_element_at(F.create_map(*sizes), pixel_type)


def construct(df: DataFrame, strict: bool = True) -> DataFrame:
    """Check image rows and cut surplus data. Bad rows raise, or with
    ``strict=False`` get their rule in ``error`` and keep their data."""
    size = element_bytes(F.col("pixel_type"))
    elements = F.when(F.octet_length("data") % size == 0, F.floor(F.octet_length("data") / size))
    channels = F.when(F.col("cspace.kind").isin("gray", "bayer"), 1).when(F.col("cspace.kind") == "rgb", 3).otherwise(F.col("cspace.channels")).cast("int")
    out = df.withColumn("channels", channels)
    error = F.when(size.isNull(), F.concat(F.lit("Unknown pixel type "), F.coalesce("pixel_type", F.lit("null"))))
    error = error.when((F.octet_length("data") % size) != 0, "Data size is not a multiple of the pixel size")
    error = F.coalesce(error, construction_error(F.col("width"), F.col("height"), F.col("channels"), elements))
    length = (F.col("width").cast("bigint") * F.col("height") * F.col("channels") * size).cast("int")
    out = out.withColumn("error", error)
    if strict:
        data = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("binary")).otherwise(F.substring("data", F.lit(1), length))
        return out.withColumn("data", data).drop("error")
    return out.withColumn("data", F.when(F.col("error").isNull(), F.substring("data", F.lit(1), length)).otherwise(F.col("data")))


def image_rows(batches):
    """Rows of Arrow batches one by one, so that one image is decoded at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
