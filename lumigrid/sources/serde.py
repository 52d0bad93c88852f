"""The checksummed wire form of images, as columns and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CSPACE, DYNAMIC, METADATA, PIXEL_TYPES, construction_error, element_bytes, struct

WIRE = struct("width int, height int, channels int").add("cspace", CSPACE)
for _field in struct("pixeltype int, compressed boolean, data binary, crc bigint").fields:
    WIRE = WIRE.add(_field)
FAILED = "Could not deserialize image"


def _tag(pixel_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k in DYNAMIC for x in (k, PIXEL_TYPES[k][3])]), pixel_type)


def _type(tag: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k in DYNAMIC for x in (PIXEL_TYPES[k][3], k)]), tag)


def serialize(images: DataFrame) -> DataFrame:
    """``image`` in wire form in place of the image columns; data is never compressed."""
    image = F.struct(
        F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("channels").cast("int").alias("channels"), "cspace",
        _tag(F.col("pixel_type")).cast("int").alias("pixeltype"), F.lit(False).alias("compressed"), "data", F.crc32("data").alias("crc"),
    )
    return images.withColumn("image", image).drop("width", "height", "channels", "cspace", "pixel_type", "data")


def deserialize(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Image columns from ``image``. Bad rows raise, or with ``strict=False``
    say why in ``error`` and have null data."""
    i = F.col("image")
    kind = _type(i["pixeltype"])
    channels = F.when(i["cspace"]["kind"].isin("gray", "bayer"), 1).when(i["cspace"]["kind"] == "rgb", 3).otherwise(i["cspace"]["channels"]).cast("int")
    elements = F.floor(F.octet_length(i["data"]) / element_bytes(kind))
    error = (
        F.when(i.isNull(), "No image")
        .when(F.crc32(i["data"]) != i["crc"], "Invalid data checksum")
        .when(kind.isNull(), "Invalid pixel type")
        .when(channels != i["channels"], "Invalid number of channels")
        .otherwise(construction_error(i["width"], i["height"], channels, elements))
    )
    out = rows.withColumn("error", error).select(
        *[c for c in rows.columns if c != "image"], i["width"].alias("width"), i["height"].alias("height"), channels.alias("channels"),
        i["cspace"].alias("cspace"), kind.alias("pixel_type"), i["data"].alias("data"), "error",
    )
    if strict:
        failed = F.raise_error(F.concat(F.lit(FAILED + ": "), F.col("error"))).cast("binary")
        return out.withColumn("data", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("data"))).drop("error")
    return out.withColumn("data", F.when(F.col("error").isNull(), F.col("data")))


def to_json(images: DataFrame) -> DataFrame:
    """image_id and ``json``: the wire form (data in base64) and the metadata."""
    rows = serialize(images)
    parts = [F.col("image")] + ([F.col("metadata")] if "metadata" in rows.columns else [])
    return rows.select("image_id", F.to_json(F.struct(*parts)).alias("json"))


def from_json(rows: DataFrame, strict: bool = True) -> DataFrame:
    schema = T.StructType([T.StructField("image", WIRE), T.StructField("metadata", METADATA)])
    parsed = rows.select("image_id", F.from_json("json", schema).alias("j")).select("image_id", "j.image", "j.metadata")
    return deserialize(parsed, strict)
