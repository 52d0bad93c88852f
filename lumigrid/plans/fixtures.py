"""Images made from the test tables, as Spark frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metadata as M

PATTERN_OF = "CASE {id} % 4 WHEN 0 THEN 'BGGR' WHEN 1 THEN 'GBRG' WHEN 2 THEN 'GRBG' ELSE 'RGGB' END"


def _read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _samples(spark, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))


_V8 = "CAST(floor(least(255D, greatest(0D, (CAST(e AS DOUBLE) + 0.3D) * 425D))) AS INT)"
_V16 = "CAST(floor(least(65535D, greatest(0D, (CAST(e AS DOUBLE) + 0.3D) * 109225D))) AS INT)"


def bayer8(spark, sf_dir: str, value: str = _V8) -> DataFrame:
    """8 x 8 mosaics: image_id, y, x, c, v, w, h, pattern."""
    return _samples(spark, sf_dir).selectExpr("image_id", "CAST(p DIV 8 AS INT) AS y", "CAST(p % 8 AS INT) AS x", "0 AS c", f"{value} AS v", "8 AS w", "8 AS h", PATTERN_OF.format(id="image_id") + " AS pattern")


def bayer16(spark, sf_dir: str) -> DataFrame:
    return bayer8(spark, sf_dir, _V16)


def gray32(spark, sf_dir: str) -> DataFrame:
    return bayer8(spark, sf_dir, "CAST(e + CAST(0.5 AS FLOAT) AS FLOAT)")


#: two more samples, whose value is 0, make the 64 of a row 22 pixels of three
_FILLED = "concat(embedding, array(CAST(-0.3 AS FLOAT), CAST(-0.3 AS FLOAT)))"
RGB_WIDTH, RGB_HEIGHT = 11, 2


def rgb8(spark, sf_dir: str) -> DataFrame:
    """11 x 2 x 3 images of all samples."""
    samples = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode(F.expr(_FILLED)).alias("p", "e"))
    return samples.selectExpr("image_id", "CAST(p DIV 33 AS INT) AS y", "CAST((p DIV 3) % 11 AS INT) AS x", "CAST(p % 3 AS INT) AS c", f"{_V8} AS v")


def _images(spark, sf_dir: str, array: str, value: str, digits: str, width: int, height: int, space: str, kind: str) -> DataFrame:
    """Image-grain rows: the samples as little-endian bytes, by way of their hex digits."""
    data = f"unhex(array_join(transform({array}, e -> {digits.format(v=value)}), ''))"
    return _read(spark, sf_dir, "embeddings").selectExpr("vec_id AS image_id", f"{width} AS width", f"{height} AS height", f"{space} AS cspace", f"'{kind}' AS pixel_type", f"{data} AS data")


_BYTE = "lpad(hex({v}), 2, '0')"
_SPACE = "named_struct('kind', '{kind}', 'pattern', {pattern}, 'channels', CAST({channels} AS SMALLINT), 'name', CAST(NULL AS STRING))"
_MOSAIC = _SPACE.format(kind="bayer", pattern=PATTERN_OF.format(id="vec_id"), channels=1)


def mosaic8_images(spark, sf_dir: str, height: int = 8) -> DataFrame:
    """The mosaics of ``bayer8``, an image a row; fewer lines leave surplus data."""
    return _images(spark, sf_dir, "embedding", _V8, _BYTE, 8, height, _MOSAIC, "u8")


def mosaic16_images(spark, sf_dir: str) -> DataFrame:
    digits = _BYTE.format(v="({v}) % 256") + " || " + _BYTE.format(v="({v}) DIV 256")
    return _images(spark, sf_dir, "embedding", _V16, digits, 8, 8, _MOSAIC, "u16")


def rgb8_images(spark, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir, _FILLED, _V8, _BYTE, RGB_WIDTH, RGB_HEIGHT, _SPACE.format(kind="rgb", pattern="CAST(NULL AS STRING)", channels=3), "u8")


def frame16(spark, sf_dir: str) -> DataFrame:
    """One mosaic, 50 wide, of all orders; its height comes from one count."""
    orders = _read(spark, sf_dir, "orders")
    height = orders.count() // 50
    return orders.selectExpr("CAST(0 AS BIGINT) AS image_id", "CAST(o_orderkey DIV 50 AS INT) AS y", "CAST(o_orderkey % 50 AS INT) AS x", "0 AS c", "CAST(CAST(floor(o_totalprice) AS BIGINT) % 65536 AS INT) AS v", "50 AS w", f"{height} AS h", "'RGGB' AS pattern").where(f"y < {height}")


def user_values(spark, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr("user_id", "CAST(least(65535, CAST(floor(value * 130D) AS BIGINT)) AS INT) AS v")


def dims(pixels: DataFrame, width: int, height: int, channels: int) -> DataFrame:
    return pixels.select("image_id").distinct().select("image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(channels).alias("channels"))


#: microseconds since the epoch of a time stamp without zone, whatever the session's zone
MICROS = "CAST(unix_date(CAST(ts AS DATE)) AS BIGINT) * 86400000000 + hour(ts) * 3600000000L + minute(ts) * 60000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)"


def event_metadata(spark, sf_dir: str) -> DataFrame:
    """image_id, cspace, metadata of every event."""
    from ..schema import GRAY

    e = _read(spark, sf_dir, "events").select(F.col("event_id").alias("image_id"), F.expr(MICROS).alias("us"), "value", "user_id")
    keys = {
        "exposure": M.item("duration", F.floor(F.col("value") * 1000000.0), "Exposure time"),
        "Camera": M.item("string", F.concat(F.lit("CAM-"), F.col("user_id").cast("string"))),
        "gain": M.item("u8", F.pmod("image_id", F.lit(256)), "Gain"),
        "offset": M.item("i32", F.col("image_id") - 100),
        "ratio": M.item("f64", F.col("value") / 4.0),
    }
    meta = M.new_metadata(F.col("us") * 1000, keys)
    return e.select("image_id", GRAY.column().alias("cspace"), meta.alias("metadata"))


# the same in SQL

SAMPLES = "SELECT vec_id AS image_id, CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings"


def _mosaic_sql(value: str) -> str:
    return f"SELECT image_id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, {value} AS v, 8 AS w, 8 AS h, {PATTERN_OF.format(id='image_id')} AS pattern FROM ({SAMPLES})"


BAYER8 = _mosaic_sql("CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (e + 0.3::DOUBLE) * 425.0::DOUBLE))) AS INTEGER)")
BAYER16 = _mosaic_sql("CAST(floor(least(65535.0::DOUBLE, greatest(0.0::DOUBLE, (e + 0.3::DOUBLE) * 109225.0::DOUBLE))) AS INTEGER)")
GRAY32 = _mosaic_sql("CAST(e AS FLOAT) + CAST(0.5 AS FLOAT)")
RGB8 = """SELECT image_id, CAST(p // 33 AS INTEGER) AS y, CAST((p // 3) % 11 AS INTEGER) AS x, CAST(p % 3 AS INTEGER) AS c, CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (e + 0.3::DOUBLE) * 425.0::DOUBLE))) AS INTEGER) AS v
FROM (SELECT image_id, CAST(unnest(f) AS DOUBLE) AS e, generate_subscripts(f, 1) - 1 AS p FROM (SELECT vec_id AS image_id, list_concat(CAST(embedding AS FLOAT[]), [-0.3::FLOAT, -0.3::FLOAT]) AS f FROM embeddings))"""
FRAME16 = "SELECT CAST(0 AS BIGINT) AS image_id, CAST(o_orderkey // 50 AS INTEGER) AS y, CAST(o_orderkey % 50 AS INTEGER) AS x, CAST(CAST(floor(o_totalprice) AS BIGINT) % 65536 AS INTEGER) AS v, 50 AS w, CAST((SELECT count(*) // 50 FROM orders) AS INTEGER) AS h, 'RGGB' AS pattern FROM orders WHERE o_orderkey // 50 < (SELECT count(*) // 50 FROM orders)"
USER_VALUES = "SELECT user_id, CAST(least(65535, CAST(floor(value * 130.0::DOUBLE) AS BIGINT)) AS INTEGER) AS v FROM events"
EVENTS = "SELECT event_id AS image_id, epoch_us(ts) AS us, value, user_id FROM events"
