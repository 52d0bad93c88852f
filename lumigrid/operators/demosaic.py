"""Demosaicing at pixel grain.

One neighbourhood of each pixel, gathered by windows over lines and columns,
feeds all methods; the interpolation itself is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cfa import colour
from ..schema import PIXEL_TYPES
from .pixels import neighbourhood

METHODS = ("none", "nearest", "linear", "cubic")
ACROSS, ALONG = [(0, -1), (0, 1)], [(-1, 0), (1, 0)]
SIGNS = [(s, t) for s in (-1, 1) for t in (-1, 1)]
CORNERS = SIGNS
FAR_AXES = [(0, -3), (0, 3), (-3, 0), (3, 0)]
KNIGHTS = [(2 * s, t) for s, t in SIGNS] + [(s, 2 * t) for s, t in SIGNS]
FAR_CORNERS = [(3 * s, 3 * t) for s, t in SIGNS]
WIDE_KNIGHTS = [(3 * s, t) for s, t in SIGNS] + [(s, 3 * t) for s, t in SIGNS]


def debayer(mosaic: DataFrame, method: str, kind: str = "u8") -> DataFrame:
    """image_id, y, x, c, v with three channels.

    mosaic: image_id, y, x, v and, the same on all rows of an image, w, h and
    pattern. An image under 2 x 2 (cubic: 4 x 4) raises WrongResolution."""
    if method not in METHODS:
        raise ValueError(f"Unknown method {method}")
    reach = {"none": 0, "nearest": 1, "linear": 1, "cubic": 3}[method]
    least = 4 if method == "cubic" else 2
    real = kind.startswith("f")
    size_ok = (F.col("w") >= least) & (F.col("h") >= least)
    base = mosaic.select("image_id", "y", "x", F.when(size_ok, F.col("v")).otherwise(F.raise_error(F.lit("WrongResolution")).cast(mosaic.schema["v"].dataType)).alias("v"), "w", "h", "pattern")
    if reach:
        base = neighbourhood(base, reach)
    zero = F.lit(0.0) if real else F.lit(0).cast("bigint")
    near = lambda dy, dx: F.get(F.get(F.col("near"), F.lit(reach + dy)), F.lit(reach + dx)).cast("double" if real else "bigint")

    def mean(taps) -> Column:
        total = near(*taps[0])
        for t in taps[1:]:
            total = total + near(*t)
        return (total / len(taps)).cast("float").cast("double") if real else F.floor(total / len(taps))

    def quotient(name: str) -> Column:
        x = F.col(name)
        if real:
            return x
        # already a whole number, truncated toward zero
        high = PIXEL_TYPES[kind][2]
        return F.when((x < PIXEL_TYPES[kind][1]) | (x > high), high).otherwise(x)

    if method == "none":
        cross = diagonal = beside = above = zero
    elif method == "nearest":
        cross, diagonal, beside, above = near(0, -1), near(-1, -1), near(0, -1), near(-1, 0)
    elif method == "linear":
        cross, diagonal, beside, above = mean(ACROSS + ALONG), mean(CORNERS), mean(ACROSS), mean(ALONG)
    else:
        # own steps for means and quotients keep each projection small enough to compile
        means = {
            "m_near": mean(ACROSS + ALONG), "m_far": mean(FAR_AXES), "m_knights": mean(KNIGHTS), "m_corners": mean(CORNERS), "m_far_corners": mean(FAR_CORNERS),
            "m_wide": mean(WIDE_KNIGHTS), "m_across": mean(ACROSS), "m_far_across": mean([(0, -3), (0, 3)]), "m_along": mean(ALONG), "m_far_along": mean([(-3, 0), (3, 0)]),
        }
        tops = {
            "q_cross": ("324 * m_near + 4 * m_far - 72 * m_knights", 256), "q_diagonal": ("324 * m_corners + 4 * m_far_corners - 72 * m_wide", 256),
            "q_beside": ("18 * m_across - 2 * m_far_across", 16), "q_above": ("18 * m_along - 2 * m_far_along", 16),
        }
        base = base.select("image_id", "y", "x", "v", "pattern", *[m.alias(n) for n, m in means.items()])
        parts = [F.expr(t) / below if real else F.call_function("div", F.expr(t), F.lit(below).cast("bigint")) for t, below in tops.values()]
        base = base.select("image_id", "y", "x", "v", "pattern", *[p.alias(n) for n, p in zip(tops, parts, strict=True)])
        cross, diagonal, beside, above = map(quotient, tops)
    own, left = colour(F.col("pattern"), F.col("y"), F.col("x")), colour(F.col("pattern"), F.col("y"), F.col("x") + 1)
    v, kind_sql = F.col("v"), "float" if real else "int"
    green = F.when(F.col("own") == "G", v).otherwise(cross).cast(kind_sql)
    side = lambda c: F.when(F.col("own") == c, v).when(F.col("own") != "G", diagonal).when(F.col("beside") == c, beside).otherwise(above).cast(kind_sql)
    out = base.withColumn("own", own).withColumn("beside", left)
    out = out.select("image_id", "y", "x", side("R").alias("r"), green.alias("g"), side("B").alias("b"))
    return out.select("image_id", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("c", "v"))
