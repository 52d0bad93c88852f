import io
import json
import os
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumigrid.functions import cfa, kernels, pointwise, rice
from lumigrid.images import ImageFrame
from lumigrid.operators import demosaic, exposure, luma, roi
from lumigrid.operators import metadata as M
from lumigrid.operators.pixels import to_arrays, to_pixels
from lumigrid.schema import GRAY, IMAGE, PATTERNS, PIXEL_TYPES, RGB, bayer, construct, custom
from lumigrid.sources import fits, imageio, serde

# fixed values: mosaics (RGGB) and what each method makes of them
EVEN = [229, 67, 95, 146, 232, 51, 229, 241, 169, 161, 15, 52, 45, 175, 98, 197]
ODD = [229, 67, 95, 146, 232, 51, 229, 241, 169]
GOLDEN = {
    ("none", 4): "229 0 0 0 67 0 95 0 0 0 146 0 0 232 0 0 0 51 0 229 0 0 0 241 169 0 0 0 161 0 15 0 0 0 52 0 0 45 0 0 0 175 0 98 0 0 0 197",
    ("nearest", 4): "229 67 51 229 67 51 95 67 51 95 146 241 229 232 51 229 232 51 95 229 51 95 229 241 169 161 51 169 161 51 15 161 51 15 52 241 169 45 175 169 45 175 15 98 175 15 98 197",
    ("linear", 4): "229 149 51 162 67 51 95 167 146 95 146 241 199 232 51 127 172 51 55 229 146 55 164 241 169 149 113 92 161 113 15 135 166 15 52 219 169 45 175 92 116 175 15 98 186 15 75 197",
    ("none", 3): "229 0 0 0 67 0 95 0 0 0 146 0 0 0 232 0 51 0 229 0 0 0 241 0 169 0 0",
    ("nearest", 3): "229 67 232 229 67 232 95 67 232 229 146 232 229 146 232 95 51 232 229 241 232 229 241 232 169 241 232",
    ("linear", 3): "229 106 232 162 67 232 95 59 232 229 146 232 180 126 232 132 51 232 229 193 232 199 241 232 169 146 232",
}
#: a 7 x 7 mosaic of 255 with zeros at these places
ZEROS = (17, 23, 24, 25, 31)
OVERFLOW = """255 255 251 255 255 255 255 255 255 255 255 255 255 255 255 255 255 255 255 255 251 255 255 255 255 255 255 255 255 255 255 190 255 255 255
255 255 255 255 255 255 255 255 255 255 255 255 255 255 111 174 255 0 111 255 111 174 255 255 255 255 255 255 255 255 255 255 190 255 255
0 111 255 255 0 255 0 111 255 190 255 255 255 255 255 255 255 255 255 255 255 111 174 255 0 111 255 111 174 255 255 255 255 255 255
255 255 255 255 255 255 255 255 255 255 190 255 255 255 255 255 255 255 255 255 255 255 255 251 255 255 255 255 255 255 255 255 255 255 255
255 255 255 255 255 255 251"""


def frame(spark, rows, strict=True):
    """rows: id, array, colour space, pixel type."""
    out = []
    for i, a, space, kind in rows:
        a = np.asarray(a)
        a = a[:, :, None] if a.ndim == 2 else a
        out.append((i, a.shape[1], a.shape[0], space.channels, (space.kind, space.pattern, space.channels, space.name), kind, bytearray(a.astype(PIXEL_TYPES[kind][0]).tobytes())))
    return ImageFrame.new(spark.createDataFrame(out, IMAGE), strict)


def arrays(images: ImageFrame):
    return {r.image_id: np.frombuffer(r.data, PIXEL_TYPES[r.pixel_type][0]).reshape(r.height, r.width, r.channels) for r in images.df.collect()}


def mosaic(spark, images):
    """Pixel-grain mosaic of (id, 2-d array, pattern)."""
    rows = [(i, y, x, v.item(), a.shape[1], a.shape[0], p) for i, a, p in images for (y, x), v in np.ndenumerate(a)]
    kind = "float" if images[0][1].dtype.kind == "f" else "int"
    return spark.createDataFrame(rows, f"image_id bigint, y int, x int, v {kind}, w int, h int, pattern string")


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[r.y, r.x, r.c] = r.v
    return {i: np.array([d[k] for k in sorted(d)]).reshape([1 + max(k[j] for k in d) for j in range(3)]) for i, d in out.items()}


def test_golden_kernels():
    for (method, n), want in GOLDEN.items():
        a = np.array(EVEN if n == 4 else ODD, np.uint8).reshape(n, n)
        assert kernels.debayer(a, "u8", "RGGB", method).ravel().tolist() == list(map(int, want.split()))
    a = np.full(49, 255, np.uint8)
    a[list(ZEROS)] = 0
    assert kernels.debayer(a.reshape(7, 7), "u8", "RGGB", "cubic").ravel().tolist() == list(map(int, OVERFLOW.split()))
    rgb = np.array([[[181, 178, 118], [183, 85, 131], [82, 143, 196], [108, 64, 33], [174, 43, 18], [236, 19, 179]]], np.uint8)
    assert kernels.luma(rgb, "u8").ravel().tolist() == [172, 119, 130, 73, 79, 102]


def test_pixel_grain_equals_kernels(spark):
    rnd = np.random.default_rng(3)
    for kind, high in (("u8", 256), ("u16", 65536), ("f32", None)):
        draw = lambda h, w: rnd.random((h, w), np.float32) if high is None else rnd.integers(0, high, (h, w)).astype(PIXEL_TYPES[kind][0])
        sizes = [(2, 2), (2, 3), (3, 2), (4, 4), (5, 7), (9, 4)]
        for method in demosaic.METHODS:
            images = [(k, draw(*s), PATTERNS[k % 4]) for k, s in enumerate(sizes) if method != "cubic" or min(s) >= 4]
            got = gathered(demosaic.debayer(mosaic(spark, images), method, kind))
            for i, a, p in images:
                want = kernels.debayer(a, kind, p, method)
                assert np.allclose(got[i], want, atol=1e-6) if high is None else (got[i] == want).all(), (kind, method, a.shape)


def test_too_small(spark):
    with pytest.raises(Exception, match="WrongResolution"):
        demosaic.debayer(mosaic(spark, [(1, np.zeros((3, 3), np.uint8), "RGGB")]), "cubic").collect()
    with pytest.raises(ValueError, match="WrongResolution"):
        kernels.debayer(np.zeros((1, 4), np.uint8), "u8", "RGGB", "linear")


def test_image_frame_flow(spark):
    rnd = np.random.default_rng(1)
    a16 = rnd.integers(0, 65536, (6, 5)).astype(np.uint16)
    images = frame(spark, [(1, np.array(EVEN).reshape(4, 4), bayer("RGGB"), "u8"), (2, a16, bayer("GBRG"), "u16")])
    got = arrays(images.debayer("linear").to_luma().cast_u8())
    for i, a, p, kind in ((1, np.array(EVEN, np.uint8).reshape(4, 4), "RGGB", "u8"), (2, a16, "GBRG", "u16")):
        assert (got[i] == kernels.cast_u8(kernels.luma(kernels.debayer(a, kind, p, "linear"), kind), kind)).all()
    props = {r.image_id: r for r in images.props().collect()}
    assert props[2].color_space == "GBRG" and props[2].len == 30 and not props[2].is_empty
    roi_ = arrays(images.select_roi(1, 1, 3, 2, shift_cfa=True))
    assert (roi_[2][:, :, 0] == a16[1:3, 1:4]).all()
    with pytest.raises(Exception, match="not debayered"):
        images.to_luma().df.collect()


def test_construction_errors(spark):
    row = lambda i, w, h, data, space=GRAY, kind="u8": (i, w, h, 1, (space.kind, space.pattern, space.channels, space.name), kind, bytearray(data))
    rows = [row(1, 65536, 1, b"a"), row(2, 2, 2, b""), row(3, 0, 2, b"a"), row(4, 2, 0, b"a"), row(5, 2, 2, b"abc"), row(6, 2, 2, b"abcdefg"), row(7, 1, 1, b"abc", GRAY, "u16"), row(8, 1, 1, b"a", custom(0, "x")), row(9, 1, 1, b"a", GRAY, "q8")]
    out = {r.image_id: r for r in construct(spark.createDataFrame(rows, IMAGE), strict=False).collect()}
    assert [out[i].error for i in range(1, 7)] == ["Image too large.", "Data is empty", "Width is zero", "Height is zero", "Not enough data for image.", None]
    assert bytes(out[6].data) == b"abcd"
    assert out[7].error and out[8].error and out[9].error
    with pytest.raises(Exception, match="Not enough data"):
        construct(spark.createDataFrame(rows[4:5], IMAGE)).collect()


def test_casts(spark):
    values = spark.range(65536).select(F.col("id").cast("int").alias("v"))
    got = {r.v: (r.c, r.f) for r in values.select("v", pointwise.cast_u8(F.col("v"), "u16").alias("c"), pointwise.floor_u8(F.col("v"), "u16").alias("f")).collect()}
    every = np.arange(65536, dtype=np.uint16)
    assert [got[i][0] for i in range(65536)] == kernels.cast_u8(every, "u16").tolist()
    assert [got[i][1] for i in range(65536)] == kernels.floor_u8(every, "u16").tolist()
    floats = [0.5, 0.4, -1.0, 2.0, float("nan"), float("inf"), 0.0, 1.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(floats)], "i int, v float").select("i", pointwise.cast_u8(F.col("v"), "f32").alias("c")).collect()
    want = [128, 102, 0, 255, 0, 255, 0, 255]
    assert [r.c for r in sorted(rows)] == want and kernels.cast_u8(np.array(floats, np.float32), "f32").tolist() == want


def test_luma_and_weights(spark):
    px = spark.createDataFrame([(1, 0, 0, c, v) for c, v in enumerate((255, 255, 255))], "image_id bigint, y int, x int, c int, v int")
    assert luma.to_luma(px).first().v == 255
    assert luma.to_luma(px, weights=(1.0, 1.0, 1.0)).first().v == 255  # clamped
    with pytest.raises(Exception, match="weights do not match"):
        luma.to_luma(px, weights=(0.5, 0.5)).collect()


def test_regions(spark):
    a = np.array([[0, 1, 2, 3, 4], [6, 5, 7, 8, 9]], np.uint8)
    assert kernels.copy_to(a[:, :, None], np.ones((3, 2, 1), np.uint8), 1, 0).ravel().tolist() == [1, 2, 5, 7, 0, 0]
    images = frame(spark, [(1, a, GRAY, "u8"), (2, np.arange(36).reshape(3, 4, 3), RGB, "u8")])
    px = to_pixels(images.df, "u8")
    for x, y, w, h in ((1, 0, 2, 3), (4, 1, 2, 2), (0, 0, 4, 2)):
        got = gathered(roi.select_roi(px.where("image_id = 1"), images.df.where("image_id = 1"), x, y, w, h)) if x == 4 else gathered(roi.select_roi(px, images.df, x, y, w, h))
        for i, own in arrays(images).items():
            if i in got:
                assert (got[i] == kernels.select_roi(own, x, y, w, h)).all()
    with pytest.raises(Exception, match="out of bounds"):
        roi.select_roi(px, images.df, 5, 0, 1, 1).collect()
    assert {r.image_id: r.pix for r in to_arrays(px).collect()}[1] == a.ravel().tolist()


def test_patterns():
    assert cfa.bayer_shift("RGGB", 1, 0) == "GBRG" and cfa.bayer_shift("RGGB", 0, 1) == "GRBG" and cfa.bayer_shift("GRBG", 1, 0) == "BGGR"
    assert cfa.geometric_shift("RGGB", 1, 0) == "GRBG"
    for p in PATTERNS:
        assert cfa.flip_horizontal(cfa.flip_horizontal(p)) == p and cfa.flip_vertical(cfa.flip_vertical(p)) == p


def test_exposure(spark):
    cfg = exposure.OptimumExposure().builder().pixel_exclusion(1).percentile_pix(0.9).max_allowed_bin(8).build()
    values = np.arange(40, 60)
    images = frame(spark, [(1, values.reshape(4, 5), GRAY, "u8"), (2, np.full((2, 5), 155), GRAY, "u8"), (3, np.zeros((2, 5)), GRAY, "u8")])
    by_pixel = exposure.optimum_exposure(to_pixels(images.df, "u8"), F.lit(1_000_000_000), F.lit(4), "u8", cfg)
    got = {r.image_id: (r.exposure_ns, r.bin) for r in by_pixel.collect()}
    assert got == {r.image_id: (r.exposure_ns, r.bin) for r in images.opt_exposure(F.lit(1_000_000_000), F.lit(4), cfg).collect()}
    assert got[2] == (1_000_000_000, 4)  # within the tolerance
    assert got[3] == (10_000_000_000, 8)
    value = np.float32(values[int(np.floor(np.float32(0.9) * np.float32(19)))])
    wanted = float(np.float32(cfg.pixel_tgt) * np.float32(255)) / float(value)
    assert got[1] == (min(10_000_000_000, round(wanted * 4 * 1e9)), 2)
    plain = exposure.OptimumExposure(pixel_exclusion=1)
    ten = frame(spark, [(1, np.arange(10).reshape(2, 5), GRAY, "u8")])
    assert [tuple(r) for r in ten.opt_exposure(F.lit(10_000_000_000), F.lit(1), plain).collect()] == [(1, 10_000_000_000, 1)]
    with pytest.raises(Exception, match="exclusion"):
        ten.opt_exposure(F.lit(1000), F.lit(1), exposure.OptimumExposure(pixel_exclusion=10)).collect()
    with pytest.raises(Exception, match="Floating point"):
        frame(spark, [(1, np.ones((20, 20)), GRAY, "f32")]).opt_exposure(F.lit(1000), F.lit(1)).collect()
    for bad in (dict(pixel_tgt=0), dict(pixel_uncertainty=2), dict(percentile_pix=1.1), dict(min_allowed_exp=10**11), dict(pixel_exclusion=70000), dict(max_allowed_bin=33)):
        with pytest.raises(ValueError):
            exposure.OptimumExposure(**bad)


def test_metadata(spark):
    images = frame(spark, [(1, np.ones((2, 2)), GRAY, "u8")]).with_timestamp(F.lit(1_700_000_000_000_000_001))
    images = images.insert_key("Camera", M.item("string", "A", "the camera")).insert_key("exposure", M.item("duration", 1_075_400_000)).insert_key("n", M.item("u64", 2**64 - 1))
    one = images.df.select(M.get_value(F.col("metadata"), "CAMERA", "string").alias("a"), M.get_value(F.col("metadata"), "camera", "u8").alias("b"), M.get_exposure(F.col("metadata")).alias("e"), M.get_timestamp(F.col("metadata")).alias("t"), M.get_value(F.col("metadata"), "n", "u64").alias("n")).first()
    assert (one.a, one.b, one.e, one.t, int(one.n)) == ("A", None, 1_075_400_000, 1_700_000_000_000_000_001, 2**64 - 1)
    assert images.remove_key("camera").df.select(F.size("metadata")).first()[0] == 3
    with pytest.raises(Exception, match="Key not found"):
        images.remove_key("nothing").df.collect()
    for bad in (lambda: M.key_name(""), lambda: M.key_name("é" * 41), lambda: M.item("string", ""), lambda: M.item("string", "x" * 4097), lambda: M.item("u8", 256), lambda: M.item("u8", 1, ""), lambda: images.insert_key("timestamp", M.item("u8", 1)), lambda: images.remove_key("Timestamp"), lambda: images.replace_key("timestamp", M.item("u8", 1))):
        with pytest.raises(ValueError):
            bad()
    assert M.key_name("é" * 40) == "É" * 40


def test_json_round_trip_and_bad_rows(spark):
    images = frame(spark, [(1, np.arange(6).reshape(2, 3), GRAY, "u16"), (2, np.random.default_rng(0).random((2, 2, 3)), RGB, "f32")]).with_timestamp(F.lit(5))
    back = ImageFrame.from_json(images.to_json())
    a, b = arrays(images), arrays(back)
    assert all((a[i] == b[i]).all() for i in a)
    rows = images.serialize()
    change = lambda **k: rows.withColumn("image", functools_with(F.col("image"), k))

    def functools_with(c, k):
        for n, v in k.items():
            c = c.withField(n, v)
        return c

    error = lambda **k: {r.error for r in serde.deserialize(change(**k), strict=False).collect()}
    assert error(crc=F.lit(1).cast("bigint")) == {"Invalid data checksum"}
    assert error(pixeltype=F.lit(9)) == {"Invalid pixel type"}
    assert error(width=F.lit(99)) == {"Not enough data for image."}
    with pytest.raises(Exception, match="Could not deserialize"):
        serde.deserialize(change(crc=F.lit(1).cast("bigint"))).collect()


def test_fits_files(spark, tmp_path):
    rnd = np.random.default_rng(2)
    sources = [(1, rnd.integers(0, 256, (3, 2)), GRAY, "u8"), (2, rnd.integers(0, 65536, (4, 5)), bayer("RGGB"), "u16"), (3, rnd.random((3, 4, 3)).astype(np.float32), RGB, "f32")]
    images = frame(spark, sources).with_timestamp(F.lit(1_700_000_000_123_456_789)).insert_key("CAMERA", M.item("string", "it's one")).insert_key("A long key, with blanks", M.item("i32", -3, "note")).insert_key("EXPOSURE", M.item("duration", 1_075_400_000, "time"))
    want = arrays(images)
    for compression in ("none", "gzip"):
        folder = f"file://{tmp_path}/{compression}"
        images.write_fits(folder, compression)
        got = fits.read_fits(spark, folder).collect()
        assert len(got) == 3 and sorted(os.listdir(tmp_path / compression)) == ["1.fits", "2.fits", "3.fits"]
        for r in got:
            i = int(os.path.basename(r.path).split(".")[0])
            assert bytes(r.data) == want[i].tobytes() and (r.height, r.width, r.channels) == want[i].shape
        keys = fits.read_header(io.BytesIO((tmp_path / compression / "2.fits").read_bytes()))
        assert keys["CAMERA"] == "it's one" and keys["COLOR_SPACE"] == "RGGB" and keys["EXPOSURE_NS"] == 75_400_000 and keys["DATE-OBS"] == "2023-11-14T22:13:20.123456"
        assert all((tmp_path / compression / f).stat().st_size % 2880 == 0 for f in os.listdir(tmp_path / compression))
    for compression in ("none", "gzip"):
        images.write_fits(f"{tmp_path}/one", compression, append=True)
        rows = fits.read_fits(spark, f"{tmp_path}/one").collect()  # files of the earlier write are gone
        assert len(rows) == 3 and all(r["keys"]["CAMERA"] == "it's one" and r["keys"]["EXPOSURE_NS"] == "75400000" for r in rows)
    with pytest.raises(Exception, match="exists"):
        images.write_fits(f"{tmp_path}/none", overwrite=False)
    with pytest.raises(Exception, match="not available"):
        images.write_fits(f"{tmp_path}/plio", "plio")
    assert fits.compression_suffix("gzip") == "[compress G]" and fits.compression_suffix("[compress G 4]") == "[compress G 4]"


def test_fits_memory_of_tasks(tmp_path):
    """What a task holds follows neither the number of images nor their size, but for one image."""
    space = {"kind": "gray", "pattern": None, "channels": None, "name": None}
    stamp = {"kind": "systemtime", "i": None, "u": None, "f": None, "s": None, "ns": 1_700_000_000_000_000_000, "comment": None}
    row = {"width": 8, "height": 8, "channels": 1, "cspace": space, "pixel_type": "u16", "metadata": [("TIMESTAMP", stamp)]}
    item = pa.struct([("kind", pa.string()), ("i", pa.int64()), ("u", pa.decimal128(20)), ("f", pa.float64()), ("s", pa.string()), ("ns", pa.int64()), ("comment", pa.string())])
    types = [("image_id", pa.int64()), ("data", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("cspace", pa.struct([(k, pa.string()) for k in space])), ("pixel_type", pa.string()), ("metadata", pa.map_(pa.string(), item))]

    def peaks(n, side):
        data = np.arange(side * side, dtype="u2").tobytes()
        batch = pa.RecordBatch.from_pylist([row | {"image_id": i, "width": side, "height": side, "data": data} for i in range(n)], schema=pa.schema(types))
        folder = f"{tmp_path}/{n}-{side}"
        writer, out, seen = fits.FitsWriter({"path": folder, "append": "true"}, True), [], 0
        for step in ("write", "read"):
            tracemalloc.start()
            before = pa.total_allocated_bytes()
            if step == "write":
                writer.commit([writer.write(iter([batch]))])
            else:
                reader = fits.FitsReader({"path": folder})
                for part in reader.partitions():
                    for rows in reader.read(part):
                        assert isinstance(rows, pa.RecordBatch) and (rows.num_rows <= fits.UNITS)
                        assert rows.nbytes < fits.UNIT_BYTES + len(data) + (1 << 20)
                        seen += rows.num_rows
                assert seen == n
            out.append(tracemalloc.get_traced_memory()[1] / 2**20 + (pa.total_allocated_bytes() - before) / 2**20)
            tracemalloc.stop()
        return out

    assert max(peaks(3000, 8)) < 4
    assert max(peaks(40, 1024)) < 30  # 2 MB each


@pytest.mark.parametrize("kind", sorted(fits.TYPES))
def test_fits_pixel_types(kind):
    store = np.dtype(fits.TYPES[kind][2])
    ends = [np.finfo(store).min, 0.25, np.finfo(store).max] if store.kind == "f" else [np.iinfo(store).min, 0, 1, np.iinfo(store).max - 1, np.iinfo(store).max]
    a = np.array([ends, ends[::-1]], store)
    units = [fits.image_hdu(a, kind, [], True), fits.tiled_hdu(a, kind, [], "gzip")]
    if kind in ("f32", "f64", "i64", "u64"):
        with pytest.raises(ValueError, match="rice"):
            fits.tiled_hdu(a, kind, [], "rice")
    else:
        units.append(fits.tiled_hdu(a, kind, [], "rice"))
    for unit in units:
        stream = io.BytesIO(unit)
        keys = fits.read_header(stream)
        back, found = fits.read_image(stream.read(fits.unit_bytes(keys)), keys)
        assert found == kind and back.dtype == store and (back == a).all()


def test_fits_long_values():
    rnd = np.random.default_rng(9)
    for n in (0, 1, 8, 60, 66, 67, 68, 69, 70, 134, 135, 200, 4096):
        for comment in (None, "note", "c" * 75, "d" * 300):
            text = "".join(rnd.choice(list("ab'& x"), n)) + "z" * (n > 0)
            cards = fits.header_card("KEY", text, comment) + fits.header_card("a long key", text, comment) + fits.header_card("NUMBER", 5, comment)
            assert len(cards) % 80 == 0
            keys = fits.read_header(io.BytesIO(fits.header([cards])))
            assert keys["KEY"] == keys["a long key"] == text and keys["NUMBER"] == 5
            said = "".join(c.rsplit(" / ", 1)[1].rstrip() for c in map("".join, zip(*[iter(fits.header_card("KEY", text, comment))] * 80)) if comment and " / " in c)
            assert said == (comment or "")


def test_rice_coding():
    rnd = np.random.default_rng(5)
    for word in ("u1", "i2", "i4"):
        low, high = np.iinfo(word).min, np.iinfo(word).max
        for a in (
            np.zeros(100), np.full(33, high), np.array([low, high] * 40), rnd.integers(low, high, 200, endpoint=True), np.cumsum(rnd.integers(-3, 4, 300)) + 100,
            rnd.integers(0, 50, 1), np.concatenate([np.zeros(64), rnd.integers(low, high, 40), np.arange(31)]), np.array([5] * 31 + [6]),
        ):
            a = a.astype(word)
            assert (rice.decode(rice.encode(a), len(a), word) == a).all()
    # by hand: first value 7, then one block of differences 0, 1, -1 with no low bits: 0, 2, 1 in unary
    assert rice.encode(np.array([7, 8, 7], "i2")) == bytes([0, 7]) + bytes([0b0001_1001, 0b0100_0000])
    smooth = (1000 + np.cumsum(rnd.integers(-2, 3, 4096))).astype("i2")
    assert len(rice.encode(smooth)) < 0.35 * smooth.nbytes


def test_tiff_round_trip(spark):
    rnd = np.random.default_rng(8)
    sources = [(1, rnd.integers(0, 256, (5, 7)), GRAY, "u8"), (2, rnd.integers(0, 65536, (3, 4, 3)), RGB, "u16"), (3, rnd.random((2, 2, 3)), RGB, "f32"), (4, rnd.random((2, 2)), GRAY, "f32"), (5, rnd.integers(0, 65536, (1, 9)), GRAY, "u16"), (6, rnd.integers(0, 256, (2, 3, 3)), RGB, "u8")]
    images = frame(spark, sources)
    files = images.to_tiff()
    assert {r.image_id: r.error for r in files.collect() if r.error} == {4: "Gray32F not supported"}
    got, want = arrays(ImageFrame.from_tiff(files.where("error is null"))), arrays(images)
    assert set(got) == {1, 2, 3, 5, 6} and all((got[i] == want[i]).all() and got[i].dtype == want[i].dtype for i in got)
    # another writer's form: big-endian, two strips
    head = struct.pack(">HHII", 256, 4, 1, 2) + struct.pack(">HHII", 257, 4, 1, 2) + struct.pack(">HHIHH", 258, 3, 1, 16, 0) + struct.pack(">HHII", 273, 4, 2, 74) + struct.pack(">HHII", 279, 4, 2, 82)
    raw = b"MM\0*" + struct.pack(">IH", 8, 5) + head + struct.pack(">I", 0) + struct.pack(">II", 94, 90) + struct.pack(">II", 4, 4) + struct.pack(">4H", 3, 4, 1, 2)
    assert imageio.tiff_pixels(raw)[:, :, 0].tolist() == [[1, 2], [3, 4]]


def test_texts_of_errors(spark):
    for space, name in ((GRAY, "Gray"), (RGB, "RGB"), (custom(2, "ir"), "Custom")):
        with pytest.raises(ValueError, match=f"{name} color space not supported in Bayer images"):
            space.cfa()
    assert bayer("rggb").cfa() == "RGGB"
    meta = spark.range(1).select(M.new_metadata(F.lit(1), {"gain": M.item("u8", 3)}).alias("m"))
    assert meta.select(M.get_value(F.col("m"), "gain", "u8", strict=True)).first()[0] == 3
    assert meta.select(M.get_value(F.col("m"), "none", "u16", strict=True)).first()[0] is None
    with pytest.raises(Exception, match="Invalid type u8"):
        meta.select(M.get_value(F.col("m"), "gain", "u16", strict=True)).collect()


def test_png_filters():
    """Every filter, line by line, against decoding byte by byte."""
    rnd = np.random.default_rng(3)
    for height, width, step in ((1, 1, 1), (5, 7, 3), (9, 4, 6), (6, 11, 2)):
        for kinds in (rnd.integers(0, 5, height), np.full(height, 4), rnd.choice([0, 2], height)):
            lines = rnd.integers(0, 256, (height, width, step)).astype(np.uint8)
            want = np.zeros((height + 1, (width + 1) * step), int)
            for y in range(height):
                for k in range(width * step):
                    left, up, corner = want[y + 1, k], want[y, k + step], want[y, k]
                    p = left + up - corner
                    paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                    want[y + 1, k + step] = (int(lines[y].ravel()[k]) + [0, left, up, (left + up) // 2, paeth][kinds[y]]) % 256
            assert (imageio._unfiltered(kinds, lines).reshape(height, -1) == want[1:, step:]).all()


def test_png_round_trip(spark):
    rnd = np.random.default_rng(4)
    images = frame(spark, [(1, rnd.integers(0, 256, (5, 7)), GRAY, "u8"), (2, rnd.integers(0, 65536, (3, 4, 3)), RGB, "u16"), (3, rnd.random((2, 2)), GRAY, "f32"), (4, np.ones((4, 4)), bayer("RGGB"), "u8")])
    files = images.to_png()
    assert {r.image_id: r.error for r in files.collect() if r.error} == {3: "Gray32F not supported", 4: "Unsupported color space"}
    got, want = arrays(ImageFrame.from_png(files.where("error is null"))), arrays(images)
    assert set(got) == {1, 2} and all((got[i] == want[i]).all() for i in got)


def test_stream_equals_batch(spark, tmp_path):
    from lumigrid.streaming import stateless

    images = frame(spark, [(k, np.full((4, 4), k), bayer("RGGB"), "u8") for k in range(5)])
    images.df.write.parquet(f"{tmp_path}/in")
    stream = stateless.read_images(spark, f"{tmp_path}/in", images.df.schema)
    stateless.transform(stream, lambda i: i.debayer("linear").to_luma(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got, want = arrays(ImageFrame(spark.read.parquet(f"{tmp_path}/out"))), arrays(images.debayer("linear").to_luma())
    assert all((got[i] == want[i]).all() for i in want) and len(got) == 5


def test_json_is_plain(spark):
    row = frame(spark, [(1, np.ones((1, 1)), GRAY, "u8")]).to_json().first()
    assert json.loads(row.json)["image"]["pixeltype"] == 8
