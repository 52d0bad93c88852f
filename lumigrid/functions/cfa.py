"""Bayer patterns: four letters, row by row of the 2 x 2 tile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PATTERNS


def colour(pattern: Column, y: Column, x: Column) -> Column:
    """R, G or B of a site."""
    return F.substring(pattern, (F.pmod(y, F.lit(2)) * 2 + F.pmod(x, F.lit(2)) + 1).cast("int"), F.lit(1))


def flip_horizontal(p: str) -> str:
    return p[1] + p[0] + p[3] + p[2]


def flip_vertical(p: str) -> str:
    return p[2:] + p[:2]


def geometric_shift(p: str, x: int, y: int) -> str:
    """The pattern seen from an origin moved x to the right and y down."""
    p = flip_horizontal(p) if x % 2 else p
    return flip_vertical(p) if y % 2 else p


def bayer_shift(p: str, x: int, y: int) -> str:
    """The pattern after a shift whose first argument counts rows, the second columns."""
    return geometric_shift(p, y, x)


def _mapped(pattern: Column, rule) -> Column:
    return F.create_map(*[F.lit(v) for p in PATTERNS for v in (p, rule(p))])[pattern]


def flip_horizontal_col(pattern: Column) -> Column:
    return _mapped(pattern, flip_horizontal)


def flip_vertical_col(pattern: Column) -> Column:
    return _mapped(pattern, flip_vertical)


def bayer_shift_col(pattern: Column, x: Column, y: Column) -> Column:
    rows = F.when(F.pmod(x, F.lit(2)) == 1, flip_vertical_col(pattern)).otherwise(pattern)
    return F.when(F.pmod(y, F.lit(2)) == 1, flip_horizontal_col(rows)).otherwise(rows)
