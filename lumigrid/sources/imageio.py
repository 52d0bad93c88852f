"""Exchange with common image files: which images have a file form; PNG (whole numbers) and TIFF (floats too) in and out."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GRAY, IMAGE, RGB, image_rows

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def export_error(cspace: Column, channels: Column, pixel_type: Column) -> Column:
    """Why an image has no form in common image files, or null."""
    return (
        F.when(channels > 4, "Too many channels")
        .when(~cspace["kind"].isin("gray", "rgb"), "Unsupported color space")
        .when((cspace["kind"] == "gray") & (pixel_type == "f32"), "Gray32F not supported")
        .when(~pixel_type.isin("u8", "u16", "f32"), "Unknown image type")
    )


def export_kind(cspace: Column, pixel_type: Column) -> Column:
    """Luma8, Luma16, Rgb8, Rgb16 or Rgb32F."""
    base = F.when(cspace["kind"] == "gray", "Luma").otherwise("Rgb")
    return F.concat(base, F.when(pixel_type == "u8", "8").when(pixel_type == "u16", "16").otherwise("32F"))


def png_bytes(a: np.ndarray) -> bytes:
    """(height, width, 1 or 3) of 8 or 16 bits."""
    height, width, channels = a.shape
    raw = a.astype(">u2" if a.dtype.itemsize == 2 else "u1").reshape(height, -1).view(np.uint8)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), raw], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8 * a.dtype.itemsize, 2 if channels == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """Pixels of a gray or RGB file of 8 or 16 bits; alpha, palettes and interlacing are refused."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        own = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", own) if kind == b"IHDR" else head
        body += own if kind == b"IDAT" else b""
        at += size + 12
    width, height, depth, colour, _, _, interlaced = head
    if colour not in (0, 2) or depth not in (8, 16) or interlaced:
        raise ValueError("Unknown image type")
    channels = 3 if colour == 2 else 1
    step = channels * depth // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = _unfiltered(lines[:, 0], lines[:, 1:].reshape(height, width, step))
    return np.frombuffer(out.tobytes(), ">u2" if depth == 16 else "u1").astype(np.uint16 if depth == 16 else np.uint8).reshape(height, width, channels)


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """(height, width, bytes of a pixel) with the lines' filters undone.

    A pixel needs its left, upper and upper left neighbours, so all pixels of one
    x + y are worked out together."""
    height, width, step = lines.shape
    if not np.isin(kinds, (1, 3, 4)).any():
        # lines of filter 0 are themselves, those of filter 2 add to the line above
        out, above = np.empty_like(lines), np.zeros_like(lines[0])
        for y in range(height):
            above = out[y] = lines[y] + above if kinds[y] == 2 else lines[y]
        return out
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for d in range(width + height - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x, kind = d - y, kinds[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, nearest], 0)
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


#: fixed values of TIFF: tags of a gray or RGB image in one strip
_WIDTH, _HEIGHT, _BITS, _PACKED, _PHOTOMETRIC, _STRIP, _SAMPLES, _ROWS, _STRIP_BYTES, _PLANAR, _FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
_TIFF_TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}


def tiff_bytes(a: np.ndarray) -> bytes:
    """(height, width, 1 or 3) of 8 or 16 bits or 32-bit floats, little-endian, not compressed."""
    height, width, channels = a.shape
    body = a.astype(a.dtype.newbyteorder("<")).tobytes()
    size, real = a.dtype.itemsize, a.dtype.kind == "f"
    lists = struct.pack(f"<{channels}H", *[8 * size] * channels) + struct.pack(f"<{channels}H", *[3 if real else 1] * channels)
    at = 8 + 2 + 11 * 12 + 4
    tags = [(_WIDTH, 4, 1, width), (_HEIGHT, 4, 1, height), (_BITS, 3, channels, at if channels > 2 else 8 * size), (_PACKED, 3, 1, 1), (_PHOTOMETRIC, 3, 1, 2 if channels == 3 else 1), (_STRIP, 4, 1, at + len(lists))]
    tags += [(_SAMPLES, 3, 1, channels), (_ROWS, 4, 1, height), (_STRIP_BYTES, 4, 1, len(body)), (_PLANAR, 3, 1, 1), (_FORMAT, 3, channels, at + 2 * channels if channels > 2 else 3 if real else 1)]
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0) + lists + body


def tiff_pixels(data: bytes) -> np.ndarray:
    """Pixels of a gray or RGB file of 8 or 16 bits or 32-bit floats, either byte order, in any number of strips; compressed ones are refused."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for k in range(n):
        place = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, place)
        if kind in _TIFF_TYPES:
            code, size = _TIFF_TYPES[kind]
            if size * count > 4:
                (place,) = struct.unpack_from(f"{order}I", data, place + 8)
            else:
                place += 8
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    channels, bits, form = one(_SAMPLES, 1), one(_BITS, 1), one(_FORMAT, 1)
    word = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}.get((bits, form))
    if one(_PACKED, 1) != 1 or one(_PLANAR, 1) != 1 or not word or (channels, one(_PHOTOMETRIC, 1)) not in ((1, 1), (3, 2)):
        raise ValueError("Unknown image type")
    body = b"".join(data[s : s + size] for s, size in zip(tags[_STRIP], tags[_STRIP_BYTES], strict=True))
    return np.frombuffer(body, order + word).astype(word).reshape(one(_HEIGHT, 0), one(_WIDTH, 0), channels)


_STORAGE = {"u8": "<u1", "u16": "<u2", "f32": "<f4"}


def _to_files(images: DataFrame, name: str, error: Column, encode) -> DataFrame:
    """image_id, ``name`` and error, an image at a time."""

    def run(batches):
        for row in image_rows(batches):
            a = None if row["error"] else np.frombuffer(row["data"], _STORAGE[row["pixel_type"]]).reshape(row["height"], row["width"], row["channels"])
            yield pa.RecordBatch.from_arrays([pa.array([row["image_id"]], pa.int64()), pa.array([None if a is None else encode(a)], pa.binary()), pa.array([row["error"]], pa.string())], names=["image_id", name, "error"])

    cols = images.select("image_id", "width", "height", "channels", "pixel_type", "data", error.alias("error"))
    return cols.mapInArrow(run, f"image_id bigint, {name} binary, error string")


def _from_files(files: DataFrame, name: str, decode) -> DataFrame:
    def run(batches):
        for row in image_rows(batches):
            a = decode(row[name])
            space = RGB if a.shape[2] == 3 else GRAY
            kind = {"u1": "u8", "u2": "u16", "f4": "f32"}[a.dtype.str[1:]]
            if space is GRAY and kind == "f32":
                raise ValueError("Unknown image type")
            out = {
                "image_id": row["image_id"], "width": a.shape[1], "height": a.shape[0], "channels": a.shape[2],
                "cspace": {"kind": space.kind, "pattern": None, "channels": space.channels, "name": None},
                "pixel_type": kind, "data": a.astype(_STORAGE[kind]).tobytes(),
            }
            yield pa.RecordBatch.from_pylist([out], schema=_ARROW)

    return files.select("image_id", name).mapInArrow(run, IMAGE)


def to_png(images: DataFrame) -> DataFrame:
    """image_id, png and error (for images without that form; floats have none)."""
    error = export_error(F.col("cspace"), F.col("channels"), F.col("pixel_type"))
    return _to_files(images, "png", F.coalesce(error, F.when(F.col("pixel_type") == "f32", "PNG holds no floating point pixels")), png_bytes)


def from_png(files: DataFrame) -> DataFrame:
    """Image rows of (image_id, png)."""
    return _from_files(files, "png", png_pixels)


def to_tiff(images: DataFrame) -> DataFrame:
    """image_id, tiff and error (for images without a form in common image files)."""
    return _to_files(images, "tiff", export_error(F.col("cspace"), F.col("channels"), F.col("pixel_type")), tiff_bytes)


def from_tiff(files: DataFrame) -> DataFrame:
    """Image rows of (image_id, tiff)."""
    return _from_files(files, "tiff", tiff_pixels)


_ARROW = pa.schema([
    ("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()),
    ("cspace", pa.struct([("kind", pa.string()), ("pattern", pa.string()), ("channels", pa.int16()), ("name", pa.string())])),
    ("pixel_type", pa.string()), ("data", pa.binary()),
])
