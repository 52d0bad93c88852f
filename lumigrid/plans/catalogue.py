"""Named queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import cfa, pointwise
from ..images import ImageFrame
from ..operators import demosaic, exposure, luma, pixels, roi
from ..operators import metadata as M
from ..schema import GRAY, PATTERNS, RGB, bayer, construction_error, cspace_text, custom
from ..session import scratch
from ..sources import fits, imageio, serde
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# properties and construction


def _frames(spark, d):
    """The 8-bit mosaics and RGB images of the tables, checked."""
    return ImageFrame.new(X.mosaic8_images(spark, d).unionByName(X.rgb8_images(spark, d)))


def _typed(spark, d):
    return ImageFrame.new(X.mosaic8_images(spark, d).unionByName(X.mosaic16_images(spark, d)))


@query(f"""SELECT image_id, 8 AS width, 8 AS height, 1 AS channels, any_value(pattern) AS color_space, 'u8' AS pixel_type, CAST(64 AS BIGINT) AS len, false AS is_empty FROM ({X.BAYER8}) GROUP BY image_id
UNION ALL SELECT image_id, 11, 2, 3, 'RGB', 'u8', CAST(66 AS BIGINT), false FROM ({X.RGB8}) GROUP BY image_id""")
def image_props(spark, d):
    return _frames(spark, d).props()


@query("""SELECT image_id, CASE WHEN w > 65535 OR h > 65535 THEN 'Image too large.' WHEN n = 0 THEN 'Data is empty' WHEN w = 0 THEN 'Width is zero' WHEN h = 0 THEN 'Height is zero' WHEN w * h > n THEN 'Not enough data for image.' END AS error
FROM (SELECT vec_id AS image_id, CASE vec_id % 6 WHEN 0 THEN 65536 WHEN 2 THEN 0 ELSE 8 END AS w, CASE vec_id % 6 WHEN 3 THEN 0 WHEN 4 THEN 9 ELSE 8 END AS h, CASE vec_id % 6 WHEN 1 THEN 0 ELSE len(embedding) END AS n FROM embeddings)""")
def validate_images(spark, d):
    e = X._read(spark, d, "embeddings").selectExpr("vec_id AS image_id", "CASE vec_id % 6 WHEN 0 THEN 65536 WHEN 2 THEN 0 ELSE 8 END AS w", "CASE vec_id % 6 WHEN 3 THEN 0 WHEN 4 THEN 9 ELSE 8 END AS h", "CASE vec_id % 6 WHEN 1 THEN 0 ELSE size(embedding) END AS n")
    return e.select("image_id", construction_error(F.col("w"), F.col("h"), F.lit(1), F.col("n")).alias("error"))


@query(f"SELECT image_id, y, x, v FROM ({X.BAYER8})")
def raw_pixels(spark, d):
    return ImageFrame.new(X.mosaic8_images(spark, d)).pixels("u8").drop("c")


@query(f"SELECT image_id, y, x, v FROM ({X.BAYER8}) WHERE y < 7")
def from_raw_surplus(spark, d):
    """Images of seven lines from the bytes of eight: the surplus is cut."""
    return ImageFrame.new(X.mosaic8_images(spark, d, height=7)).pixels("u8").drop("c")


@query(f"SELECT image_id, upper(string_agg(printf('%02x', v % 256) || printf('%02x', v // 256), '' ORDER BY y, x)) AS bytes FROM ({X.BAYER16}) GROUP BY image_id")
def raw_bytes(spark, d):
    """Little-endian bytes, as hex text."""
    return ImageFrame.new(X.mosaic16_images(spark, d)).raw().select("image_id", F.hex("data").alias("bytes"))


@query(f"SELECT image_id, v AS v_u8, 'u8' AS pixel_type FROM ({X.BAYER8}) UNION ALL SELECT image_id, NULL, 'u16' FROM ({X.BAYER16})")
def typed_view(spark, d):
    """Samples of the images that are of the type asked for; none of the others'."""
    all_ = _typed(spark, d)
    u8 = all_.pixels("u8").select("image_id", F.col("v").alias("v_u8"), F.lit("u8").alias("pixel_type"))
    return u8.unionByName(all_.pixels("u16").select("image_id", F.lit(None).cast("int").alias("v_u8"), F.lit("u16").alias("pixel_type")))


@query(f"SELECT image_id, count(*) AS n FROM ({X.BAYER8}) GROUP BY image_id")
def dyn_filter_u8(spark, d):
    return _typed(spark, d).of_type("u8").pixels("u8").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, pattern, kind = 'bayer' AS is_bayer FROM (VALUES ('gray', NULL), ('rgb', NULL), ('custom', NULL), ('bayer', 'BGGR'), ('bayer', 'GBRG'), ('bayer', 'GRBG'), ('bayer', 'RGGB')) t(kind, pattern)")
def color_spaces(spark, d):
    spaces = [GRAY, RGB, custom(2, "ir"), *map(bayer, PATTERNS)]
    return spark.createDataFrame([(s.kind, s.pattern, s.is_bayer) for s in spaces], "kind string, pattern string, is_bayer boolean")


# points


@query(f"SELECT image_id, y, x, CAST((v + 128) // 257 AS INTEGER) AS v FROM ({X.BAYER16})")
def cast_u8_u16(spark, d):
    return X.bayer16(spark, d).select("image_id", "y", "x", pointwise.cast_u8(F.col("v"), "u16").alias("v"))


@query(f"SELECT image_id, y, x, CAST(v // 257 AS INTEGER) AS v FROM ({X.BAYER16})")
def floor_u8_u16(spark, d):
    return X.bayer16(spark, d).select("image_id", "y", "x", pointwise.floor_u8(F.col("v"), "u16").alias("v"))


def _f32_sql(add: str) -> str:
    return f"SELECT image_id, y, x, CAST(least(255.0::DOUBLE, greatest(0.0::DOUBLE, floor(CAST(v * 255.0::FLOAT AS DOUBLE) + {add}::DOUBLE))) AS INTEGER) AS v FROM ({X.GRAY32})"


@query(_f32_sql("0.5"))
def cast_u8_f32(spark, d):
    return X.gray32(spark, d).select("image_id", "y", "x", pointwise.cast_u8(F.col("v"), "f32").alias("v"))


@query(_f32_sql("0.0"))
def floor_u8_f32(spark, d):
    return X.gray32(spark, d).select("image_id", "y", "x", pointwise.floor_u8(F.col("v"), "f32").alias("v"))


def _luma_sql(source: str, weights=pointwise.LUMA, high: int = 255) -> str:
    total = " + ".join(f"CAST(v{k} AS DOUBLE) * {w!r}::DOUBLE" for k, w in enumerate(weights))
    each = ", ".join(f"max(CASE WHEN c = {k} THEN v END) AS v{k}" for k in range(3))
    return f"SELECT image_id, y, x, CAST(trunc(least({high}.0::DOUBLE, {total})) AS INTEGER) AS v FROM (SELECT image_id, y, x, {each} FROM ({source}) GROUP BY ALL)"


@query(_luma_sql(X.RGB8))
def luma_rgb(spark, d):
    return luma.to_luma(X.rgb8(spark, d)).drop("c")


@query(_luma_sql(X.RGB8, (0.2126, 0.7152, 0.3)))
def luma_custom_rgb(spark, d):
    return luma.to_luma(X.rgb8(spark, d), weights=(0.2126, 0.7152, 0.3)).drop("c")


@query(f"SELECT image_id, sum(v) / 22.0::DOUBLE AS mean_luma FROM ({_luma_sql(X.RGB8)}) GROUP BY image_id")
def luma_mean_per_image(spark, d):
    """At image grain, where a pixel's channels are together: nothing is shuffled but one sum per image and task."""
    gray = ImageFrame.new(X.rgb8_images(spark, d)).to_luma()
    return gray.pixels("u8").groupBy("image_id").agg((F.sum("v") / 22.0).alias("mean_luma"))


# demosaicing


def debayer_sql(source: str, method: str, high: int = 255, real: bool = False) -> str:
    """Neighbours by joins on reflected coordinates; the cubic method's many by places in a list of the image's samples."""
    listed = method == "cubic"
    refl = lambda at, by, n: f"CASE WHEN abs({at} + {by}) > {n} - 1 THEN 2 * ({n} - 1) - abs({at} + {by}) ELSE abs({at} + {by}) END"
    used: dict[tuple, str] = {}

    def near(dy, dx):
        return f"CAST({place(dy, dx)} AS DOUBLE)" if real else place(dy, dx)

    def place(dy, dx):
        if listed:
            return f"s.p[CAST(({refl('s.y', dy, 's.h')}) * s.w + ({refl('s.x', dx, 's.w')}) + 1 AS BIGINT)]"
        return used.setdefault((dy, dx), f"n{len(used)}") + ".v"

    def mean(taps):
        total = " + ".join(near(*t) for t in taps)
        return f"CAST(CAST(({total}) / {len(taps)}.0::DOUBLE AS FLOAT) AS DOUBLE)" if real else f"(({total}) // {len(taps)})"

    def quotient(top, below):
        if real:
            return f"(({top}) / {below}.0::DOUBLE)"
        x = f"trunc(({top}) / {below}.0::DOUBLE)"
        return f"CASE WHEN {x} < 0 OR {x} > {high} THEN {high} ELSE {x} END"

    D = demosaic
    if method == "none":
        cross = diagonal = beside = above = "0"
    elif method == "nearest":
        cross, diagonal, beside, above = near(0, -1), near(-1, -1), near(0, -1), near(-1, 0)
    elif method == "linear":
        cross, diagonal, beside, above = mean(D.ACROSS + D.ALONG), mean(D.CORNERS), mean(D.ACROSS), mean(D.ALONG)
    else:
        cross = quotient(f"324 * {mean(D.ACROSS + D.ALONG)} + 4 * {mean(D.FAR_AXES)} - 72 * {mean(D.KNIGHTS)}", 256)
        diagonal = quotient(f"324 * {mean(D.CORNERS)} + 4 * {mean(D.FAR_CORNERS)} - 72 * {mean(D.WIDE_KNIGHTS)}", 256)
        beside = quotient(f"18 * {mean(D.ACROSS)} - 2 * {mean([(0, -3), (0, 3)])}", 16)
        above = quotient(f"18 * {mean(D.ALONG)} - 2 * {mean([(-3, 0), (3, 0)])}", 16)
    joins = " ".join(f"JOIN px {n} ON {n}.image_id = s.image_id AND {n}.y = {refl('s.y', dy, 's.h')} AND {n}.x = {refl('s.x', dx, 's.w')}" for (dy, dx), n in used.items())
    letter = lambda y, x: f"substr(s.pattern, CAST(1 + ({y} % 2) * 2 + ({x}) % 2 AS BIGINT), 1)"
    own, side = letter("s.y", "s.x"), letter("s.y", "s.x + 1")
    value = f"CASE WHEN t.l = {own} THEN s.v WHEN t.l = 'G' THEN {cross} WHEN {own} <> 'G' THEN {diagonal} WHEN t.l = {side} THEN {beside} ELSE {above} END"
    rows = "(SELECT px.*, i.p FROM px JOIN (SELECT image_id, list(v ORDER BY y, x) AS p FROM px GROUP BY image_id) i USING (image_id))" if listed else "px"
    return f"WITH px AS ({source}) SELECT s.image_id, s.y, s.x, t.c, CAST({value} AS {'FLOAT' if real else 'INTEGER'}) AS v FROM {rows} s CROSS JOIN (VALUES (0, 'R'), (1, 'G'), (2, 'B')) t(c, l) {joins}"


def _debayer(name: str, source, sql: str, method: str, kind: str, high: int):
    def run(spark, d):
        return demosaic.debayer(source(spark, d), method, kind)

    run.__name__ = name
    query(debayer_sql(sql, method, high, kind == "f32"))(run)


for _m in demosaic.METHODS:
    _debayer(f"debayer_{_m}", X.bayer8, X.BAYER8, _m, "u8", 255)
for _m in ("nearest", "linear", "cubic"):
    _debayer(f"debayer_{_m}_u16", X.bayer16, X.BAYER16, _m, "u16", 65535)
for _m in demosaic.METHODS:
    _debayer(f"debayer_{_m}_f32", X.gray32, X.GRAY32, _m, "f32", 1)
_debayer("debayer_linear_frame", X.frame16, X.FRAME16, "linear", "u16", 65535)


@query(_luma_sql(f"({debayer_sql(X.BAYER8, 'linear')})"))
def debayer_then_luma(spark, d):
    return luma.to_luma(demosaic.debayer(X.bayer8(spark, d), "linear")).drop("c")


_GRID = "SELECT p AS pattern, x, y FROM (VALUES ('BGGR'), ('GBRG'), ('GRBG'), ('RGGB')) a(p) CROSS JOIN (VALUES (0), (1), (2), (3)) b(x) CROSS JOIN (VALUES (0), (1), (2), (3)) c(y)"
_HF, _VF = "substr({p}, 2, 1) || substr({p}, 1, 1) || substr({p}, 4, 1) || substr({p}, 3, 1)", "substr({p}, 3, 2) || substr({p}, 1, 2)"


@query(f"SELECT pattern, x, y, CASE WHEN y % 2 = 1 THEN {_HF.format(p='r')} ELSE r END AS shifted FROM (SELECT pattern, x, y, CASE WHEN x % 2 = 1 THEN {_VF.format(p='pattern')} ELSE pattern END AS r FROM ({_GRID}))")
def bayer_shift(spark, d):
    grid = spark.createDataFrame([(p, x, y) for p in PATTERNS for x in range(4) for y in range(4)], "pattern string, x int, y int")
    return grid.select("pattern", "x", "y", cfa.bayer_shift_col(F.col("pattern"), F.col("x"), F.col("y")).alias("shifted"))


@query(f"SELECT DISTINCT pattern, {_HF.format(p='pattern')} AS horizontal, {_VF.format(p='pattern')} AS vertical FROM ({_GRID})")
def bayer_flip(spark, d):
    p = F.col("pattern")
    return spark.createDataFrame([(p_,) for p_ in PATTERNS], "pattern string").select(p, cfa.flip_horizontal_col(p).alias("horizontal"), cfa.flip_vertical_col(p).alias("vertical"))


# regions


def _roi_sql(source: str, x: int, y: int, w: int, h: int, channels: int) -> str:
    return f"""WITH px AS ({source}), ids AS (SELECT DISTINCT image_id FROM px)
SELECT i.image_id, CAST(gy.y AS INTEGER) AS y, CAST(gx.x AS INTEGER) AS x, CAST(gc.c AS INTEGER) AS c, CAST(coalesce(px.v, 0) AS INTEGER) AS v FROM ids i
CROSS JOIN range({h}) gy(y) CROSS JOIN range({w}) gx(x) CROSS JOIN range({channels}) gc(c)
LEFT JOIN px ON px.image_id = i.image_id AND px.y = gy.y + {y} AND px.x = gx.x + {x} AND px.c = gc.c"""


_B8C = f"SELECT image_id, y, x, 0 AS c, v FROM ({X.BAYER8})"


@query(_roi_sql(_B8C, 2, 1, 4, 5, 1))
def select_roi_inside(spark, d):
    px = X.bayer8(spark, d).select("image_id", "y", "x", "c", "v")
    return roi.select_roi(px, X.dims(px, 8, 8, 1), 2, 1, 4, 5)


@query(_roi_sql(_B8C, 5, 6, 6, 4, 1))
def select_roi_clipped(spark, d):
    px = X.bayer8(spark, d).select("image_id", "y", "x", "c", "v")
    return roi.select_roi(px, X.dims(px, 8, 8, 1), 5, 6, 6, 4)


@query(_roi_sql(X.RGB8, 9, 1, 3, 3, 3))
def select_roi_rgb(spark, d):
    px = X.rgb8(spark, d)
    return roi.select_roi(px, X.dims(px, X.RGB_WIDTH, X.RGB_HEIGHT, 3), 9, 1, 3, 3)


@query(_roi_sql(_B8C, 9, 0, 3, 3, 1))
def copy_roi_no_overlap(spark, d):
    px = X.bayer8(spark, d).select("image_id", "y", "x", "c", "v")
    return roi.copy_to(px, X.dims(px, 8, 8, 1), 3, 3, 9, 0)


@query(_roi_sql(_B8C, 3, 4, 10, 6, 1))
def copy_roi(spark, d):
    px = X.bayer8(spark, d).select("image_id", "y", "x", "c", "v")
    return roi.copy_to(px, X.dims(px, 8, 8, 1), 10, 6, 3, 4)


@query(f"SELECT image_id, y, x, CAST((v + 128) // 257 AS INTEGER) AS v FROM ({_roi_sql(f'SELECT image_id, y, x, 0 AS c, v FROM ({X.BAYER16})', 2, 2, 4, 4, 1)})")
def crop_preview(spark, d):
    px = X.bayer16(spark, d).select("image_id", "y", "x", "c", "v")
    return roi.select_roi(px, X.dims(px, 8, 8, 1), 2, 2, 4, 4).select("image_id", "y", "x", pointwise.cast_u8(F.col("v"), "u16").alias("v"))


# the same operations at image grain


def _image_grain(name: str, sql: str, source, kind: str, f):
    def run(spark, d):
        return f(ImageFrame.new(source(spark, d))).pixels(kind)

    run.__name__ = name
    query(sql)(run)


_image_grain("img_cast_u8", f"SELECT image_id, y, x, 0 AS c, CAST((v + 128) // 257 AS INTEGER) AS v FROM ({X.BAYER16})", X.mosaic16_images, "u8", ImageFrame.cast_u8)
_image_grain("img_floor_u8", f"SELECT image_id, y, x, 0 AS c, CAST(v // 257 AS INTEGER) AS v FROM ({X.BAYER16})", X.mosaic16_images, "u8", ImageFrame.floor_u8)
_image_grain("img_luma", f"SELECT *, 0 AS c FROM ({_luma_sql(X.RGB8)})", X.rgb8_images, "u8", ImageFrame.to_luma)
_image_grain("img_luma_of_gray", f"SELECT *, 0 AS c FROM ({_luma_sql(X.RGB8)})", X.rgb8_images, "u8", lambda f: f.to_luma().to_luma())
for _m in demosaic.METHODS:
    _image_grain(f"img_debayer_{_m}", debayer_sql(X.BAYER16, _m, 65535), X.mosaic16_images, "u16", lambda f, m=_m: f.debayer(m))
_image_grain("img_select_roi", _roi_sql(X.RGB8, 9, 1, 3, 3, 3), X.rgb8_images, "u8", lambda f: f.select_roi(9, 1, 3, 3))
_image_grain("img_copy_to", _roi_sql(_B8C, 3, 4, 10, 6, 1), X.mosaic8_images, "u8", lambda f: f.copy_to(10, 6, 3, 4))


# borders of a mosaic's lines


def _border_sql(how: str, padding: int) -> str:
    at = {
        "none": "j",
        "mirror": "CASE WHEN abs(j) > 7 THEN 14 - abs(j) ELSE abs(j) END",
        "replicate": "CASE WHEN j < 0 THEN j & 1 WHEN j > 7 THEN 6 + (j & 1) ELSE j END",
    }[how]
    reach = 0 if how == "none" else padding
    return f"WITH px AS ({X.BAYER8}) SELECT px.image_id, px.y, CAST(j AS INTEGER) AS x, px.v FROM px JOIN (SELECT j, {at} AS src FROM range({-reach}, {8 + reach}) r(j)) ON px.x = src"


def _border(how: str):
    def run(spark, d):
        return pixels.bordered(X.bayer8(spark, d), 3, how).select("image_id", "y", "x", "v")

    run.__name__ = f"border_{how}"
    query(_border_sql(how, 3))(run)


for _h in pixels.BORDERS:
    _border(_h)


# samples in other types


@query(f"SELECT image_id, y, x, CAST(trunc(least(255.0::DOUBLE, greatest(0.0::DOUBLE, CAST(v AS DOUBLE) * 300.0::DOUBLE - 20.0::DOUBLE))) AS INTEGER) AS v_u8, CAST(trunc(least(127.0::DOUBLE, greatest(-128.0::DOUBLE, CAST(v AS DOUBLE) * 300.0::DOUBLE - 200.0::DOUBLE))) AS INTEGER) AS v_i8, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(v AS DOUBLE) * 2.0::DOUBLE - 0.5::DOUBLE)) AS v_f64 FROM ({X.GRAY32})")
def from_f64(spark, d):
    x = pointwise.to_f64(F.col("v"))
    return X.gray32(spark, d).select(
        "image_id", "y", "x", pointwise.from_f64(x * 300.0 - 20.0, "u8").alias("v_u8"), pointwise.from_f64(x * 300.0 - 200.0, "i8").alias("v_i8"), pointwise.from_f64(x * 2.0 - 0.5, "f64").alias("v_f64")
    )


# exposure


def _exposure_sql(source: str, key: str, cfg: exposure.OptimumExposure, ns: int, bin_: int) -> str:
    tgt, unc = np.float32(cfg.pixel_tgt) * np.float32(65535), np.float32(cfg.pixel_uncertainty) * np.float32(65535)
    e, b = "w", f"CAST({bin_} AS INTEGER)"
    most = max(1, cfg.max_allowed_bin)
    sel = f"SELECT {key}, n, value, CAST(round_even(abs({float(tgt)!r}::DOUBLE * {float(ns // 1000)!r}::DOUBLE * 0.000001::DOUBLE / CAST(CASE WHEN f <= 0.00001::FLOAT THEN 0.00001::FLOAT ELSE f END AS DOUBLE)) * 1000000000.0::DOUBLE, 0) AS BIGINT) AS w, abs({float(tgt)!r}::FLOAT - f) < {float(unc)!r}::FLOAT AS fine FROM chosen"
    sql = f"SELECT {key}, n, value, fine, w, {e} AS e, {b} AS b FROM ({sel})"
    if most > 1:
        for _ in range(6):
            sql = f"SELECT {key}, n, value, fine, w, CASE WHEN w < {cfg.max_allowed_exp} THEN (CASE WHEN e < {cfg.max_allowed_exp} AND b > 2 THEN e * 4 ELSE e END) ELSE (CASE WHEN e > {cfg.max_allowed_exp} AND b * 2 <= {most} THEN e // 4 ELSE e END) END AS e, CASE WHEN w < {cfg.max_allowed_exp} THEN (CASE WHEN e < {cfg.max_allowed_exp} AND b > 2 THEN b // 2 ELSE b END) ELSE (CASE WHEN e > {cfg.max_allowed_exp} AND b * 2 <= {most} THEN b * 2 ELSE b END) END AS b FROM ({sql})"
    return f"""WITH px AS ({source}), r AS (SELECT {key}, v, row_number() OVER (PARTITION BY {key} ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM px),
ranked AS (SELECT *, CAST(floor(CAST({float(np.float32(cfg.percentile_pix))!r} AS FLOAT) * CAST(n - 1 AS FLOAT)) AS BIGINT) AS c0 FROM r),
chosen AS (SELECT {key}, n, v AS value, CAST(v AS FLOAT) AS f FROM ranked WHERE rn = CASE WHEN c0 < {cfg.pixel_exclusion} THEN n - 1 - {cfg.pixel_exclusion} ELSE c0 END)
SELECT {key}, n, value, CAST(CASE WHEN fine THEN {ns} ELSE least({cfg.max_allowed_exp}, greatest({cfg.min_allowed_exp}, e)) END AS BIGINT) AS exposure_ns, CAST(CASE WHEN fine THEN {bin_} ELSE least({most}, greatest(1, b)) END AS INTEGER) AS bin FROM ({sql})"""


PLAIN = exposure.OptimumExposure(pixel_exclusion=5)
BINNED = exposure.OptimumExposure(pixel_exclusion=5, percentile_pix=0.5, max_allowed_bin=8, max_allowed_exp=2_000_000_000)


@query(_exposure_sql(X.USER_VALUES, "user_id", PLAIN, 500_000_000, 1))
def opt_exposure(spark, d):
    return exposure.optimum_exposure(X.user_values(spark, d), F.lit(500_000_000), F.lit(1), "u16", PLAIN, "user_id")


@query(_exposure_sql(X.USER_VALUES, "user_id", BINNED, 1_500_000_000, 4))
def opt_exposure_binning(spark, d):
    return exposure.optimum_exposure(X.user_values(spark, d), F.lit(1_500_000_000), F.lit(4), "u16", BINNED, "user_id")


@query(_exposure_sql(f"SELECT image_id, v FROM ({X.FRAME16})", "image_id", BINNED, 40_000_000, 8))
def opt_exposure_frame(spark, d):
    return exposure.optimum_exposure(X.frame16(spark, d), F.lit(40_000_000), F.lit(8), "u16", BINNED)


#: settings that the builder takes or refuses, and what it says
_SETTINGS = {
    "plain": ({}, None),
    "target": ({"pixel_tgt": 1.5}, "Target pixel value must be between 1.6e-5 and 1"),
    "low target": ({"pixel_tgt": 0.0}, "Target pixel value must be between 1.6e-5 and 1"),
    "uncertainty": ({"pixel_uncertainty": 2.0}, "Pixel uncertainty must be between 1.6e-5 and 1"),
    "percentile": ({"percentile_pix": 1.01}, "Percentile must be between 0 and 1."),
    "exposures": ({"min_allowed_exp": 5, "max_allowed_exp": 5}, "Minimum allowed exposure must be less than maximum allowed exposure"),
    "exclusion": ({"pixel_exclusion": 65537}, "Pixel exclusion must be less than 65536"),
    "binning": ({"max_allowed_bin": 33}, "Maximum allowed binning must be less than 32"),
    "edges": ({"percentile_pix": 1.0, "pixel_exclusion": 65536, "max_allowed_bin": 32}, None),
}


def _built(settings: dict) -> str | None:
    builder = exposure.OptimumExposure().builder()
    for name, value in settings.items():
        builder = getattr(builder, name)(value)
    try:
        builder.build()
    except ValueError as e:
        return str(e)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {'CAST(NULL AS VARCHAR)' if error is None else repr(error)})" for name, (_, error) in _SETTINGS.items()) + ") t(setting, error)")
def exposure_settings(spark, d):
    return spark.createDataFrame([(name, _built(settings)) for name, (settings, _) in _SETTINGS.items()], "setting string, error string")


# metadata

_KEYS = """SELECT image_id, 'TIMESTAMP' AS key, 'systemtime' AS kind, CAST(NULL AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS VARCHAR) AS s, us * 1000 AS ns, 'Timestamp of the image' AS comment FROM ({e})
UNION ALL SELECT image_id, 'EXPOSURE', 'duration', NULL, NULL, NULL, CAST(floor(value * 1000000.0::DOUBLE) AS BIGINT), 'Exposure time' FROM ({e})
UNION ALL SELECT image_id, 'CAMERA', 'string', NULL, NULL, 'CAM-' || user_id, NULL, NULL FROM ({e})
UNION ALL SELECT image_id, 'GAIN', 'u8', image_id % 256, NULL, NULL, NULL, 'Gain' FROM ({e})
UNION ALL SELECT image_id, 'OFFSET', 'i32', image_id - 100, NULL, NULL, NULL, NULL FROM ({e})
UNION ALL SELECT image_id, 'RATIO', 'f64', NULL, value / 4.0::DOUBLE, NULL, NULL, NULL FROM ({e})""".format(e=X.EVENTS)


def _exploded(df):
    return df.select("image_id", F.explode("metadata").alias("key", "m")).select("image_id", "key", "m.kind", "m.i", "m.f", "m.s", "m.ns", "m.comment")


@query(_KEYS)
def meta_explode(spark, d):
    return _exploded(X.event_metadata(spark, d))


@query(f"SELECT * FROM ({_KEYS}) WHERE key <> 'GAIN' UNION ALL SELECT image_id, 'GAIN', 'u16', 7, NULL, NULL, NULL, 'new' FROM ({X.EVENTS}) UNION ALL SELECT image_id, 'LENS', 'string', NULL, NULL, 'f/2', NULL, NULL FROM ({X.EVENTS})")
def meta_insert(spark, d):
    meta = M.insert_key(M.insert_key(F.col("metadata"), "gain", M.item("u16", 7, "new")), "Lens", M.item("string", "f/2"))
    return _exploded(X.event_metadata(spark, d).withColumn("metadata", meta))


@query(f"SELECT * FROM ({_KEYS}) WHERE key <> 'OFFSET'")
def meta_remove(spark, d):
    return _exploded(X.event_metadata(spark, d).withColumn("metadata", M.remove_key(F.col("metadata"), "offset")))


@query(f"SELECT * FROM ({_KEYS}) WHERE key <> 'CAMERA' UNION ALL SELECT image_id, 'CAMERA', 'string', NULL, NULL, 'other', NULL, 'swapped' FROM ({X.EVENTS})")
def meta_replace(spark, d):
    meta = M.replace_key(F.col("metadata"), "camera", M.item("string", "other", "swapped"))
    return _exploded(X.event_metadata(spark, d).withColumn("metadata", meta))


@query(f"SELECT image_id, image_id % 256 AS gain_u8, CAST(NULL AS BIGINT) AS gain_u16, image_id - 100 AS offset_i32, value / 4.0::DOUBLE AS ratio_f64, 'CAM-' || user_id AS camera, 'Gain' AS gain_comment, CAST(NULL AS VARCHAR) AS missing FROM ({X.EVENTS})")
def meta_get_typed(spark, d):
    m = F.col("metadata")
    return X.event_metadata(spark, d).select(
        "image_id", M.get_value(m, "gain", "u8").alias("gain_u8"), M.get_value(m, "Gain", "u16").alias("gain_u16"), M.get_value(m, "OFFSET", "i32").alias("offset_i32"),
        M.get_value(m, "ratio", "f64").alias("ratio_f64"), M.get_value(m, "camera", "string").alias("camera"), M.get_comment(m, "gain").alias("gain_comment"), M.get_value(m, "nothing", "string").alias("missing"),
    )


@query(f"""SELECT image_id, image_id * 4294967296 AS big_u64, CAST(NULL AS BIGINT) AS big_i64, -image_id AS long_i64, CAST(CAST(value AS FLOAT) AS DOUBLE) AS single_f32, CAST(NULL AS DOUBLE) AS single_f64,
us * 10 AS span_ns, CAST(NULL AS BIGINT) AS span_moment, us * 1000 AS moment_ns, 'RGGB' AS space, image_id % 200 - 100 AS small_i8, image_id % 65536 AS word_u16 FROM ({X.EVENTS})""")
def meta_get_types(spark, d):
    """Each kind is found by its own type only."""
    e = X._read(spark, d, "events").select(F.col("event_id").alias("image_id"), F.expr(X.MICROS).alias("us"), "value")
    keys = {
        "big": M.item("u64", F.col("image_id").cast("decimal(20,0)") * 4294967296), "long": M.item("i64", -F.col("image_id")), "single": M.item("f32", F.col("value")), "span": M.item("duration", F.col("us") * 10),
        "moment": M.item("systemtime", F.col("us") * 1000), "space": M.item("colorspace", bayer("RGGB")), "small": M.item("i8", F.pmod("image_id", F.lit(200)) - 100), "word": M.item("u16", F.pmod("image_id", F.lit(65536))),
    }
    m = F.col("metadata")
    get = lambda name, kind: M.get_value(m, name, kind)
    return e.select("image_id", M.new_metadata(F.col("us") * 1000, keys).alias("metadata")).select(
        "image_id", get("BIG", "u64").cast("bigint").alias("big_u64"), get("big", "i64").alias("big_i64"), get("long", "i64").alias("long_i64"), get("single", "f32").alias("single_f32"),
        get("single", "f64").alias("single_f64"), get("span", "duration").alias("span_ns"), get("span", "systemtime").alias("span_moment"), get("moment", "systemtime").alias("moment_ns"),
        get("space", "colorspace").alias("space"), get("small", "i8").alias("small_i8"), get("word", "u16").alias("word_u16"),
    )


@query(f"SELECT image_id, us * 1000 AS timestamp_ns FROM ({X.EVENTS})")
def timestamp_key(spark, d):
    return X.event_metadata(spark, d).select("image_id", M.get_timestamp(F.col("metadata")).alias("timestamp_ns"))


@query(f"SELECT image_id, CAST(floor(value * 1000000.0::DOUBLE) AS BIGINT) AS exposure_ns FROM ({X.EVENTS})")
def exposure_key(spark, d):
    return X.event_metadata(spark, d).select("image_id", M.get_exposure(F.col("metadata")).alias("exposure_ns"))


# sinks


@query(f"""WITH k AS ({_KEYS}), e AS ({X.EVENTS})
SELECT image_id, 'DATE-OBS' AS key, 'str' AS kind, CAST(NULL AS DOUBLE) AS fvalue, CAST(NULL AS BIGINT) AS ivalue, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') AS svalue, CAST(NULL AS VARCHAR) AS comment FROM e
UNION ALL SELECT image_id, 'COLOR_SPACE', 'str', NULL, NULL, 'GRAY', NULL FROM e
UNION ALL SELECT image_id, key, 'int', NULL, i, NULL, comment FROM k WHERE kind IN ('u8', 'i32')
UNION ALL SELECT image_id, key, 'float', f, NULL, NULL, comment FROM k WHERE kind = 'f64'
UNION ALL SELECT image_id, key, 'str', NULL, NULL, s, comment FROM k WHERE kind = 'string'
UNION ALL SELECT image_id, 'EXPOSURE_S', 'int', NULL, ns // 1000000000, NULL, comment || ' (s)' FROM k WHERE kind = 'duration'
UNION ALL SELECT image_id, 'EXPOSURE_NS', 'int', NULL, ns % 1000000000, NULL, comment || ' (ns)' FROM k WHERE kind = 'duration'
UNION ALL SELECT image_id, 'EXPOSURE', 'float', CAST(ns // 1000000000 AS DOUBLE) + CAST(ns % 1000000000 AS DOUBLE) / 1000000000.0::DOUBLE, NULL, NULL, comment FROM k WHERE kind = 'duration'
UNION ALL SELECT image_id, 'TIMESTAMP_S', 'int', NULL, ns // 1000000000, NULL, comment || ' (s from EPOCH)' FROM k WHERE kind = 'systemtime'
UNION ALL SELECT image_id, 'TIMESTAMP_NS', 'int', NULL, ns % 1000000000, NULL, comment || ' (ns from EPOCH)' FROM k WHERE kind = 'systemtime'""")
def fits_header_cards(spark, d):
    return fits.cards(X.event_metadata(spark, d)).withColumn("ivalue", F.col("ivalue").cast("bigint"))


#: a text and a line feed as an image: as many lines of at most 65,535 bytes as it takes, of one width, the last filled up with blanks
_TEXT = "SELECT doc_id AS image_id, t, n, CAST(ceil(n / 65535.0) AS INTEGER) AS height FROM (SELECT doc_id, coalesce(text, '') || chr(10) AS t, octet_length(encode(coalesce(text, ''))) + 1 AS n FROM documents)"
_FILLED_TEXT = f"SELECT image_id, height, CAST(ceil(n / CAST(height AS DOUBLE)) AS INTEGER) AS width, t || repeat(' ', CAST(ceil(n / CAST(height AS DOUBLE)) * height - n AS BIGINT)) AS t FROM ({_TEXT})"


def _document_images(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    docs = X._read(spark, d, "documents").select(F.col("doc_id").alias("image_id"), text.alias("t"), F.octet_length(F.encode(text, "utf-8")).alias("n"))
    docs = docs.withColumn("height", F.ceil(F.col("n") / 65535).cast("int")).withColumn("width", F.ceil(F.col("n") / F.col("height")).cast("int"))
    data = F.encode(F.concat("t", F.repeat(F.lit(" "), F.col("width") * F.col("height") - F.col("n"))), "utf-8")
    return docs.select("image_id", "width", "height", F.lit(1).alias("channels"), GRAY.column().alias("cspace"), F.lit("u8").alias("pixel_type"), data.alias("data"))


@query(f"SELECT image_id, width, height, CASE WHEN image_id % 7 = 3 THEN 'Invalid data checksum' END AS error, CASE WHEN image_id % 7 <> 3 THEN sha1(t) END AS data_sha1 FROM ({_FILLED_TEXT})")
def serde_crc(spark, d):
    rows = serde.serialize(_document_images(spark, d))
    broken = rows.withColumn("image", F.when(F.pmod("image_id", F.lit(7)) == 3, F.col("image").withField("crc", F.col("image.crc") + 1)).otherwise(F.col("image")))
    return serde.deserialize(broken, strict=False).select("image_id", "width", "height", "error", F.sha1("data").alias("data_sha1"))


@query(f"SELECT image_id, width, height, 'GRAY' AS color_space, 'u8' AS pixel_type, sha1(t) AS data_sha1 FROM ({_FILLED_TEXT})")
def serde_json_roundtrip(spark, d):
    back = serde.from_json(serde.to_json(_document_images(spark, d)), strict=False)
    return back.select("image_id", "width", "height", cspace_text(F.col("cspace")).alias("color_space"), "pixel_type", F.sha1("data").alias("data_sha1"))


@query(_KEYS)
def json_metadata_roundtrip(spark, d):
    """Metadata of every kind through JSON, beside a one-pixel image."""
    one = X.event_metadata(spark, d).select("image_id", F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(1).alias("channels"), "cspace", F.lit("u8").alias("pixel_type"), F.unhex(F.lit("2A")).alias("data"), "metadata")
    return _exploded(serde.from_json(serde.to_json(one)))


def _with_id(spark, d):
    """The 16-bit mosaics with their number in the metadata, since appended units have no name of their own."""
    images = ImageFrame.new(X.mosaic16_images(spark, d)).with_timestamp(F.lit(1_700_000_000_000_000_000))
    return images.insert_key("NUMBER", M.item("i64", F.col("image_id")))


def _through_fits(spark, d, compression):
    path = scratch(spark, "fits")
    _with_id(spark, d).write_fits(path, compression, append=True)
    back = fits.read_fits(spark, path)
    return ImageFrame(back.withColumn("image_id", F.expr("CAST(keys['NUMBER'] AS BIGINT)"))).pixels("u16").drop("c")


@query(f"SELECT image_id, y, x, v FROM ({X.BAYER16})")
def fits_roundtrip(spark, d):
    return _through_fits(spark, d, "none")


@query(f"SELECT image_id, y, x, v FROM ({X.BAYER16})")
def fits_roundtrip_gzip(spark, d):
    return _through_fits(spark, d, "gzip")


@query(f"SELECT image_id, y, x, v FROM ({X.BAYER16})")
def fits_roundtrip_rice(spark, d):
    return _through_fits(spark, d, "rice")


@query(f"SELECT image_id, y, x, c, CAST(v AS FLOAT) / 255.0::FLOAT AS v FROM ({X.RGB8})")
def tiff_roundtrip_f32(spark, d):
    """Floating point pixels, which PNG has no form for."""
    floats = ImageFrame.new(X.rgb8_images(spark, d)).operate(lambda a, r: (a.astype("f4") / np.float32(255), "f32", RGB))
    return ImageFrame.from_tiff(floats.to_tiff().where("error IS NULL")).pixels("f32")


@query(X.RGB8)
def png_roundtrip(spark, d):
    files = ImageFrame.new(X.rgb8_images(spark, d)).to_png()
    return ImageFrame.from_png(files.where("error IS NULL")).pixels("u8")


@query("""SELECT space, kind, CASE WHEN ch > 4 THEN 'Too many channels' WHEN space NOT IN ('GRAY', 'RGB') THEN 'Unsupported color space' WHEN space = 'GRAY' AND kind = 'f32' THEN 'Gray32F not supported' END AS error,
CASE WHEN space IN ('GRAY', 'RGB') AND NOT (space = 'GRAY' AND kind = 'f32') THEN CASE space WHEN 'GRAY' THEN 'Luma' ELSE 'Rgb' END || CASE kind WHEN 'u8' THEN '8' WHEN 'u16' THEN '16' ELSE '32F' END END AS becomes
FROM (VALUES ('GRAY', 1), ('RGB', 3), ('RGGB', 1), ('C(2, a)', 2), ('C(5, b)', 5)) s(space, ch) CROSS JOIN (VALUES ('u8'), ('u16'), ('f32')) k(kind)""")
def interop_validity(spark, d):
    rows = [(s.kind, s.pattern, s.channels, s.name, k) for s in (GRAY, RGB, bayer("RGGB"), custom(2, "a"), custom(5, "b")) for k in ("u8", "u16", "f32")]
    t = spark.createDataFrame(rows, "kind string, pattern string, channels smallint, name string, pixel_type string")
    space = F.struct("kind", "pattern", "channels", "name")
    error = imageio.export_error(space, F.col("channels"), F.col("pixel_type"))
    return t.select(cspace_text(space).alias("space"), F.col("pixel_type").alias("kind"), error.alias("error"), F.when(error.isNull(), imageio.export_kind(space, F.col("pixel_type"))).alias("becomes"))
