"""Point-wise expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PIXEL_TYPES

LUMA = (0.299, 0.587, 0.114)


def _scaled(v: Column, kind: str) -> Column:
    _, low, high, _ = PIXEL_TYPES[kind]
    f = lambda x: F.lit(float(x)).cast("float")
    if kind == "f32":
        return (v.cast("float") * f(255)).cast("float")
    return (((v.cast("float") - f(low)) / (f(high) - f(low))).cast("float") * f(255)).cast("float")


def _saturated(x: Column) -> Column:
    return F.when(F.isnan(x), 0).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x)).cast("int")).cast("int")


def cast_u8(v: Column, kind: str) -> Column:
    """Scaled to 0..255, half away from zero, saturating; NaN gives 0."""
    if kind == "u8":
        return v.cast("int")
    if kind == "u16":  # equal to the single-precision formula for every 16-bit value
        return F.floor((v.cast("int") + 128) / 257).cast("int")
    x = _scaled(v, kind).cast("double")
    return _saturated(F.when(F.isnan(x) | (F.abs(x) > 1e9), x).otherwise(F.floor(x + 0.5).cast("double")))


def floor_u8(v: Column, kind: str) -> Column:
    if kind == "u8":
        return v.cast("int")
    if kind == "u16":
        return F.floor(v.cast("int") / 257).cast("int")
    x = _scaled(v, kind).cast("double")
    return _saturated(F.when(F.isnan(x) | (F.abs(x) > 1e9), x).otherwise(F.floor(x).cast("double")))


def to_f64(v: Column) -> Column:
    return v.cast("double")


def to_f32(v: Column) -> Column:
    return v.cast("float")


def from_f64(x: Column, kind: str) -> Column:
    """Back to a pixel type: integers truncate, all are clamped to the type's range; NaN stays in floats, and is 0 in integers."""
    _, low, high, _ = PIXEL_TYPES[kind]
    bounded = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))
    if kind in ("f32", "f64"):
        return F.when(F.isnan(x), x).otherwise(bounded).cast("float" if kind == "f32" else "double")
    return F.when(F.isnan(x), 0).otherwise(bounded.cast("bigint")).cast("bigint" if kind == "u32" else "int")


from_f32 = from_f64


def luma(channels: list[Column], kind: str, weights=LUMA) -> Column:
    """Weighted sum, left to right in double precision."""
    if len(channels) != len(weights):
        raise ValueError("Number of channels and weights do not match.")
    total = F.lit(0.0)
    for v, w in zip(channels, weights, strict=True):
        total = total + v.cast("double") * F.lit(float(w))
    return from_f64(total, kind)
