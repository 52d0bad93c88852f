"""Image-grain frames with methods.

All methods are lazy DataFrame transformations. Pixel work runs in numpy over
Arrow batches, one image at a time; metadata and dimensions stay columns, so a
query that only asks for those never reads ``data``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .functions import cfa, kernels
from .operators import exposure, metadata
from .schema import CSPACE, DYNAMIC, IMAGE, METADATA, PIXEL_TYPES, RGB, ColorSpace, construct, cspace_text, image_rows
from .sources import fits, imageio, serde


class ImageFrame:
    """Rows of images; see ``schema`` for the columns."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def new(cls, df: DataFrame, strict: bool = True) -> ImageFrame:
        """From image_id, width, height, cspace, pixel_type, data: checked, and cut to size."""
        return cls(construct(df, strict))

    @classmethod
    def from_png(cls, files: DataFrame) -> ImageFrame:
        return cls(imageio.from_png(files))

    @classmethod
    def from_tiff(cls, files: DataFrame) -> ImageFrame:
        return cls(imageio.from_tiff(files))

    @classmethod
    def from_json(cls, rows: DataFrame, strict: bool = True) -> ImageFrame:
        return cls(serde.from_json(rows, strict))

    @property
    def has_metadata(self) -> bool:
        return "metadata" in self.df.columns

    # properties

    def props(self) -> DataFrame:
        size = F.col("width").cast("bigint") * F.col("height") * F.col("channels")
        return self.df.select("image_id", "width", "height", "channels", cspace_text(F.col("cspace")).alias("color_space"), "pixel_type", size.alias("len"), (size == 0).alias("is_empty"))

    def of_type(self, kind: str) -> ImageFrame:
        """Images of one pixel type; the others are left out."""
        return ImageFrame(self.df.where(F.col("pixel_type") == kind))

    def raw(self) -> DataFrame:
        return self.df.select("image_id", "data")

    def pixels(self, kind: str) -> DataFrame:
        from .operators.pixels import to_pixels

        return to_pixels(self.df, kind)

    # pixel work

    def operate(self, f: Callable[[np.ndarray, dict], tuple[np.ndarray, str, ColorSpace]]) -> ImageFrame:
        """Apply f(pixels (height, width, channels), row) -> (pixels, pixel type, colour space) to every image; metadata is kept."""
        # results may be null where this frame's expressions can't be
        schema = StructType([StructField(x.name, CSPACE if x.name == "cspace" else x.dataType) for x in self.df.schema.fields])

        def run(batches):
            for batch in batches:
                for row in image_rows([batch]):
                    a = np.frombuffer(row["data"], PIXEL_TYPES[row["pixel_type"]][0])[: row["height"] * row["width"] * row["channels"]]
                    out, kind, space = f(a.reshape(row["height"], row["width"], row["channels"]), row)
                    space = {"kind": space.kind, "pattern": space.pattern, "channels": space.channels, "name": space.name}
                    new = {"height": out.shape[0], "width": out.shape[1], "channels": out.shape[2], "pixel_type": kind, "cspace": space, "data": np.ascontiguousarray(out, PIXEL_TYPES[kind][0]).tobytes()}
                    yield pa.RecordBatch.from_pylist([row | new], schema=batch.schema)

        return ImageFrame(self.df.mapInArrow(run, schema))

    def cast_u8(self) -> ImageFrame:
        return self.operate(lambda a, r: (kernels.cast_u8(a, r["pixel_type"]), "u8", ColorSpace.of(r["cspace"])))

    into_u8 = cast_u8

    def floor_u8(self) -> ImageFrame:
        return self.operate(lambda a, r: (kernels.floor_u8(a, r["pixel_type"]), "u8", ColorSpace.of(r["cspace"])))

    def to_luma(self, weights=kernels.LUMA, strict: bool = False) -> ImageFrame:
        """Gray images stay as they are, or raise if strict; mosaics raise."""

        def one(a, r):
            space = ColorSpace.of(r["cspace"])
            if space.is_bayer:
                raise ValueError("Image is not debayered.")
            if space.kind == "gray":
                if strict:
                    raise ValueError("Image is already grayscale.")
                return a, r["pixel_type"], space
            return kernels.luma(a, r["pixel_type"], weights), r["pixel_type"], ColorSpace("gray")

        return self.operate(one)

    def debayer(self, method: str) -> ImageFrame:
        def one(a, r):
            space = ColorSpace.of(r["cspace"])
            return kernels.debayer(a[:, :, 0], r["pixel_type"], space.cfa(), method), r["pixel_type"], RGB

        return self.operate(one)

    def select_roi(self, x: int, y: int, width: int, height: int, shift_cfa: bool = False) -> ImageFrame:
        """A region of each image. A mosaic keeps its pattern's name unless ``shift_cfa``."""

        def one(a, r):
            space = ColorSpace.of(r["cspace"])
            if shift_cfa and space.is_bayer:
                space = ColorSpace("bayer", cfa.geometric_shift(space.pattern, x, y))
            return kernels.select_roi(a, x, y, width, height), r["pixel_type"], space

        return self.operate(one)

    def copy_to(self, width: int, height: int, x: int, y: int) -> ImageFrame:
        return self.operate(lambda a, r: (kernels.copy_to(a, np.zeros((height, width, a.shape[2]), a.dtype), x, y), r["pixel_type"], ColorSpace.of(r["cspace"])))

    def opt_exposure(self, exposure_ns: Column, bin_: Column, cfg=exposure.OptimumExposure()) -> DataFrame:
        """image_id, exposure_ns and bin; all samples of an image count alike. Floating point images raise."""

        def run(batches):
            for batch in batches:
                ids, value, size = [], [], []
                for row in batch.to_pylist():
                    a = np.frombuffer(row["data"], PIXEL_TYPES[row["pixel_type"]][0])
                    if cfg.pixel_exclusion >= len(a):
                        raise ValueError("Pixel exclusion must be less than the number of pixels")
                    share = np.float32(cfg.percentile_pix)
                    at = len(a) - 1 if share > np.float32(0.99999) else int(np.floor(share * np.float32(len(a) - 1)))
                    at = len(a) - 1 - cfg.pixel_exclusion if at < cfg.pixel_exclusion else at
                    ids.append(row["image_id"])
                    value.append(float(np.partition(a, at)[at]))
                    size.append(row["pixel_type"])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(value, pa.float64()), pa.array(size, pa.string())], names=["image_id", "value", "kind"])

        got = self.df.select("image_id", "pixel_type", "data").mapInArrow(run, "image_id bigint, value double, kind string")
        decided = F.lit(None)
        for kind in ("u8", "u16", "u32", "i8", "i16", "i32"):
            decided = F.when(F.col("kind") == kind, exposure.decide(F.col("value"), exposure_ns, bin_, kind, cfg)).otherwise(decided)
        bad = F.raise_error(F.lit("Floating point images are not supported for this operation.")).cast("struct<exposure_ns:bigint,bin:int>")
        out = got.select("image_id", F.when(F.col("kind").startswith("f"), bad).otherwise(decided).alias("o"))
        return out.select("image_id", "o.exposure_ns", "o.bin")

    # metadata

    def with_timestamp(self, timestamp_ns: Column) -> ImageFrame:
        return ImageFrame(self.df.withColumn("metadata", metadata.new_metadata(timestamp_ns)))

    def insert_key(self, name: str, value: Column) -> ImageFrame:
        return ImageFrame(self.df.withColumn("metadata", metadata.insert_key(F.col("metadata"), name, value)))

    def remove_key(self, name: str, strict: bool = True) -> ImageFrame:
        return ImageFrame(self.df.withColumn("metadata", metadata.remove_key(F.col("metadata"), name, strict)))

    def replace_key(self, name: str, value: Column, strict: bool = True, kind: str | None = None) -> ImageFrame:
        return ImageFrame(self.df.withColumn("metadata", metadata.replace_key(F.col("metadata"), name, value, strict, kind)))

    def get_key(self, name: str) -> Column:
        return metadata.get_key(self.df["metadata"], name)

    def timestamps(self) -> DataFrame:
        return self.df.select("image_id", metadata.get_timestamp(F.col("metadata")).alias("timestamp_ns"))

    def exposures(self) -> DataFrame:
        return self.df.select("image_id", metadata.get_exposure(F.col("metadata")).alias("exposure_ns"))

    def image_only(self) -> ImageFrame:
        return ImageFrame(self.df.drop("metadata"))

    # sinks

    def to_json(self) -> DataFrame:
        return serde.to_json(self.df)

    def serialize(self) -> DataFrame:
        return serde.serialize(self.df)

    def write_fits(self, path: str, compression: str = "none", overwrite: bool = True, append: bool = False) -> None:
        fits.write_fits(self.df, path, compression, overwrite, append)

    def to_png(self) -> DataFrame:
        return imageio.to_png(self.df)

    def to_tiff(self) -> DataFrame:
        return imageio.to_tiff(self.df)


__all__ = ["DYNAMIC", "IMAGE", "METADATA", "ImageFrame"]
