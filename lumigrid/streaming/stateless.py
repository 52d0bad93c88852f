"""Image operators on streams.

Every operator that works row by row at image grain (casts, luma, demosaicing,
regions, metadata, serialization) keeps no state, so it runs unchanged on a
streaming DataFrame. ``exposures`` adds the one aggregate that users ask of a
live camera: brightness by time window, late rows bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..images import ImageFrame


def read_images(spark: SparkSession, path: str, schema, max_files: int = 100) -> ImageFrame:
    """A stream of image rows from a folder of Parquet files."""
    return ImageFrame(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path))


def transform(stream: ImageFrame, f: Callable[[ImageFrame], ImageFrame], out: str, checkpoint: str):
    """Start writing ``f`` of the stream as Parquet; the query resumes from its checkpoint."""
    return f(stream).df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exposures(stream: ImageFrame, late: str = "1 minute", window: str = "1 minute") -> DataFrame:
    """Images and mean exposure per window of their time stamp; rows later than ``late`` are left out."""
    m = F.col("metadata")
    rows = stream.df.select(F.timestamp_micros(F.call_function("div", m["TIMESTAMP"]["ns"], F.lit(1000))).alias("ts"), m["EXPOSURE"]["ns"].alias("ns"))
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"), F.avg("ns").alias("mean_ns"))
