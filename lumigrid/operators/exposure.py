"""Optimum exposure: an order statistic of an image's samples against a target."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PIXEL_TYPES


@dataclass(frozen=True)
class OptimumExposure:
    """Times in nanoseconds; target and uncertainty as shares of the type's range."""

    percentile_pix: float = 0.995
    pixel_tgt: float = 40000.0 / 65536.0
    pixel_uncertainty: float = 5000.0 / 65536.0
    pixel_exclusion: int = 100
    min_allowed_exp: int = 1_000_000
    max_allowed_exp: int = 10_000_000_000
    max_allowed_bin: int = 1

    def __post_init__(self):
        low = np.float32(1.6e-5)
        if not low <= np.float32(self.pixel_tgt) <= 1:
            raise ValueError("Target pixel value must be between 1.6e-5 and 1")
        if not low <= np.float32(self.pixel_uncertainty) <= 1:
            raise ValueError("Pixel uncertainty must be between 1.6e-5 and 1")
        if not 0 <= self.percentile_pix <= 1:
            raise ValueError("Percentile must be between 0 and 1.")
        if self.min_allowed_exp >= self.max_allowed_exp:
            raise ValueError("Minimum allowed exposure must be less than maximum allowed exposure")
        if not 0 <= self.pixel_exclusion <= 65536:
            raise ValueError("Pixel exclusion must be less than 65536")
        if not 0 <= self.max_allowed_bin <= 32:
            raise ValueError("Maximum allowed binning must be less than 32")

    def builder(self) -> Builder:
        return Builder(**{f.name: getattr(self, f.name) for f in fields(self)})


class Builder:
    """Collects settings one by one; ``build`` checks them."""

    def __init__(self, **settings):
        self.settings = settings

    def __getattr__(self, name):
        if name.startswith("_") or name not in {f.name for f in fields(OptimumExposure)}:
            raise AttributeError(name)
        return lambda value: Builder(**self.settings | {name: value})

    def build(self) -> OptimumExposure:
        return replace(OptimumExposure(), **self.settings)


def _f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def position(n: Column, cfg: OptimumExposure) -> Column:
    """Rank (from 0) of the sample that is compared with the target."""
    last = n - 1
    if np.float32(cfg.percentile_pix) > np.float32(0.99999):
        at = last
    else:
        at = F.floor((_f32(cfg.percentile_pix) * _f32(last)).cast("float"))
    at = F.when(at < cfg.pixel_exclusion, last - cfg.pixel_exclusion).otherwise(at)
    return F.when(n <= cfg.pixel_exclusion, F.raise_error(F.lit("Pixel exclusion must be less than the number of pixels")).cast("bigint")).otherwise(at)


def decide(value: Column, exposure_ns: Column, bin_: Column, kind: str, cfg: OptimumExposure) -> Column:
    """struct(exposure_ns, bin) for the sample's value."""
    if kind.startswith("f"):
        raise ValueError("Floating point images are not supported for this operation.")
    high = np.float32(PIXEL_TYPES[kind][2])
    target, room = np.float32(cfg.pixel_tgt) * high, np.float32(cfg.pixel_uncertainty) * high
    val = _f32(value)
    fine = F.abs((_f32(target) - val).cast("float")) < _f32(room)
    floor = F.when(val <= _f32(1e-5), _f32(1e-5)).otherwise(val).cast("double")
    micros = F.floor(exposure_ns / 1000).cast("double")
    # seconds to whole nanoseconds, to nearest
    wanted = F.rint(F.abs(F.lit(float(target)) * micros * F.lit(1e-6) / floor) * 1e9).cast("bigint")
    most = max(1, cfg.max_allowed_bin)
    state = F.struct(wanted.alias("e"), bin_.cast("int").alias("b"))
    if most > 1:
        smaller = F.aggregate(F.sequence(F.lit(1), F.lit(16)), state, lambda s, _: F.when((s["e"] < cfg.max_allowed_exp) & (s["b"] > 2), F.struct((s["e"] * 4).alias("e"), F.floor(s["b"] / 2).cast("int").alias("b"))).otherwise(s))
        larger = F.aggregate(F.sequence(F.lit(1), F.lit(6)), state, lambda s, _: F.when((s["e"] > cfg.max_allowed_exp) & (s["b"] * 2 <= most), F.struct(F.floor(s["e"] / 4).alias("e"), (s["b"] * 2).cast("int").alias("b"))).otherwise(s))
        state = F.when(wanted < cfg.max_allowed_exp, smaller).otherwise(larger)
    exposure = F.least(F.lit(cfg.max_allowed_exp), F.greatest(F.lit(cfg.min_allowed_exp), state["e"])).cast("bigint")
    bin_out = F.least(F.lit(most), F.greatest(F.lit(1), state["b"])).cast("int")
    same = F.struct(exposure_ns.cast("bigint").alias("exposure_ns"), bin_.cast("int").alias("bin"))
    new = F.struct(exposure.alias("exposure_ns"), bin_out.alias("bin"))
    checked = F.when(bin_ < 1, F.raise_error(F.lit("Binning must be at least 1"))).otherwise(F.lit(None))
    return F.when(checked.isNull() & fine, same).otherwise(new)


def optimum_exposure(pixels: DataFrame, exposure_ns: Column, bin_: Column, kind: str = "u16", cfg: OptimumExposure = OptimumExposure(), key: str = "image_id") -> DataFrame:
    """key, n, value, exposure_ns, bin per image of (key, v); the exposure and bin are expressions over an image's maxima of columns.

    Samples are counted by value first, so no task sorts an image: the rank runs
    over at most as many rows as the type has values."""
    counts = pixels.groupBy(key, "v").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.select(key, "v", F.sum("k").over(upto).alias("upto"), F.sum("k").over(Window.partitionBy(key)).alias("n"))
    at = position(F.col("n"), cfg)
    chosen = ranked.where(F.col("upto") > at).groupBy(key).agg(F.max("n").alias("n"), F.min("v").alias("value"))
    out = chosen.select(key, "n", "value", decide(F.col("value"), exposure_ns, bin_, kind, cfg).alias("o"))
    return out.select(key, "n", "value", "o.exposure_ns", "o.bin")
