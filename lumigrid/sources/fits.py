"""FITS: header cards as rows, and a Python data source that writes and reads files.

Each image is a file ``<image_id>.fits`` (``append`` option: one file a task, an
image extension each). Without compression the image is the primary HDU; with
``gzip`` or ``rice`` the image is a tiled-image table, a row of pixels a tile, and
its header has the keys; so has the primary one of a file of its own. Rice takes
whole numbers of 8 to 32 bits. Other codecs live in native libraries and are refused. String values and comments over a card's end
go on in CONTINUE cards; the format has ASCII only, other characters become "?".
"""

from __future__ import annotations

import datetime
import gzip
import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import rice
from ..schema import META_VALUE, ColorSpace, cspace_text, image_rows

BLOCK = 2880
#: names of compressions and their suffix in an extended file name
COMPRESSIONS = {"none": "", "gzip": "[compress G]", "rice": "[compress R]", "hcompress": "[compress H]", "hsmooth": "[compress HS]", "bzip2": "[compress B]", "plio": "[compress P]"}
#: fixed values of the format: pixel type, BITPIX, BZERO, numpy type. A type with a BZERO is stored with its top bit turned
TYPES = {
    "u8": (8, 0, "u1"), "i8": (8, -128, "i1"), "i16": (16, 0, "i2"), "u16": (16, 32768, "u2"), "i32": (32, 0, "i4"), "u32": (32, 2147483648, "u4"),
    "i64": (64, 0, "i8"), "u64": (64, 9223372036854775808, "u8"), "f32": (-32, 0, "f4"), "f64": (-64, 0, "f8"),
}
NANOS = 1_000_000_000
#: what a card shows of its entry
DATE, SPACE, PLAIN, SECONDS, NANOSECONDS, WHOLE = range(6)


def compression_suffix(name: str) -> str:
    """Suffix of a named compression; any other text is a custom one and is used as it stands."""
    return COMPRESSIONS.get(name.lower(), name)


def _floor_div(a, n: int):
    """Whole-number division of 64-bit counts, rounding down; ``/`` would go through doubles."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))


def cards(images: DataFrame) -> DataFrame:
    """(image_id, key, kind, ivalue, fvalue, svalue, comment) of every header card
    that an image's colour space and metadata give.

    The metadata is read once: a list of (place, key, value) that says which cards
    an entry has is exploded, and the card follows from its place."""
    both = images.select("image_id", cspace_text(F.col("cspace")).alias("space"), "metadata").withColumn("stamp", F.col("metadata.TIMESTAMP.ns"))
    none = F.lit(None).cast(META_VALUE)
    entry = lambda place, k, m: F.struct(F.lit(place).alias("place"), k.alias("k"), m.alias("m"))
    parts = lambda places: (lambda e: F.transform(F.array(*map(F.lit, places)), lambda p: F.struct(p.alias("place"), e["key"].alias("k"), e["value"].alias("m"))))

    def of(e):
        kind = e["value"]["kind"]
        moment = F.when(e["value"]["comment"].isNull(), parts([SECONDS, NANOSECONDS, WHOLE])(e)).otherwise(parts([SECONDS, NANOSECONDS])(e))
        return F.when(kind == "duration", parts([SECONDS, NANOSECONDS, WHOLE])(e)).when(kind == "systemtime", moment).otherwise(parts([PLAIN])(e))

    fixed = F.array(entry(DATE, F.lit("DATE-OBS"), none), entry(SPACE, F.lit("COLOR_SPACE"), none))
    listed = F.concat(fixed, F.flatten(F.transform(F.map_entries("metadata"), of)))
    each = both.select("image_id", "space", "stamp", F.explode(listed).alias("x")).select("image_id", "space", "stamp", "x.*")
    m, k, place = F.col("m"), F.col("k"), F.col("place")
    kind, note, ns = m["kind"], m["comment"], m["ns"]
    seconds, rest, moment = _floor_div(ns, NANOS), F.pmod(ns, F.lit(NANOS)), kind == "systemtime"

    def unit(name):
        with_note = F.concat(note, F.when(moment, f" ({name} from EPOCH)").otherwise(f" ({name})"))
        return F.coalesce(with_note, F.when(moment, f"{name} from EPOCH").otherwise(f"({name})"))

    micros = _floor_div(F.col("stamp"), 1000)
    second = _floor_div(micros, 1_000_000)
    # the calendar of a count of seconds, without a session time zone
    day = F.date_add(F.lit("1970-01-01").cast("date"), _floor_div(second, 86400).cast("int"))
    clock = F.pmod(second, F.lit(86400))
    date = F.format_string("%sT%02d:%02d:%02d.%06d", day.cast("string"), _floor_div(clock, 3600), _floor_div(F.pmod(clock, F.lit(3600)), 60), F.pmod(clock, F.lit(60)), F.pmod(micros, F.lit(1_000_000)))
    sort = F.when(kind.isin("string", "colorspace"), "str").when(kind.isin("f32", "f64"), "float").otherwise("int")
    return each.select(
        "image_id",
        F.when(place == SECONDS, F.concat(k, F.lit("_S"))).when(place == NANOSECONDS, F.concat(k, F.lit("_NS"))).otherwise(k).alias("key"),
        F.when(place.isin(DATE, SPACE), "str").when(place == WHOLE, "float").when(place == PLAIN, sort).otherwise("int").alias("kind"),
        F.when(place == SECONDS, seconds.cast("decimal(20,0)")).when(place == NANOSECONDS, rest.cast("decimal(20,0)")).when(place == PLAIN, F.coalesce(m["i"].cast("decimal(20,0)"), m["u"])).alias("ivalue"),
        F.when(place == WHOLE, seconds.cast("double") + rest.cast("double") / 1e9).when(place == PLAIN, m["f"]).alias("fvalue"),
        F.when(place == DATE, date).when(place == SPACE, F.col("space")).when(place == PLAIN, m["s"]).alias("svalue"),
        F.when(place == SECONDS, unit("s")).when(place == NANOSECONDS, unit("ns")).when(place == WHOLE, F.coalesce(note, F.when(moment, "s from EPOCH").otherwise("s"))).when(place == PLAIN, note).alias("comment"),
    )


def _string_cards(head: str, value: str, comment: str) -> list[str]:
    """A string value in as many cards as it takes: each but the last ends in &."""
    units, parts, room = re.findall(r"''|.", value.replace("'", "''"), re.S), [""], 80 - len(head) - 3
    for u in units:
        if len(parts[-1]) + len(u) > room:
            parts.append("")
            room = 67
        parts[-1] += u
    heads = [head, *["CONTINUE  "] * (len(parts) - 1)]
    out = [f"{h}'{x}&'" for h, x in zip(heads[:-1], parts[:-1], strict=True)]
    last = f"{heads[-1]}'{parts[-1]:<8}'"
    if not comment:
        return [*out, last]
    if len(last) + 3 + len(comment) <= 80:
        return [*out, f"{last} / {comment}"]
    # the comment starts behind the value's end, and goes on behind empty values
    last, pieces = f"{heads[-1]}'{parts[-1]}&'", []
    while comment:
        room = 80 - 3 - (len(last) if not pieces else 13)
        pieces.append(comment[: max(room, 0)])
        comment = comment[max(room, 0) :]
    out.append(f"{last} / {pieces[0]}" if pieces[0] else last)
    return [*out, *[f"CONTINUE  '{'' if i == len(pieces) - 1 else '&'}' / {x}" for i, x in enumerate(pieces) if i]]


def header_card(key: str, value, comment: str | None = None) -> str:
    """One 80-character card or several; long or lower-case keys use the HIERARCH convention."""
    ascii_ = lambda x: re.sub(r"[^ -~]", "?", x)
    plain = re.fullmatch(r"[A-Z0-9_-]{1,8}", key)
    head, comment = ascii_(f"{key:<8}= " if plain else f"HIERARCH {key} = "), ascii_(comment or "")
    if isinstance(value, str):
        return "".join(f"{c:<80}" for c in _string_cards(head, ascii_(value), comment))
    text = ("T" if value else "F") if isinstance(value, bool) else f"{value:d}" if isinstance(value, int) else f"{value!r}".upper()
    out = head + (f"{text:>20}" if plain else text) + (f" / {comment}" if comment else "")
    # what is left of a number's comment follows in comment cards
    rest = [f"COMMENT {out[i : i + 72]}" for i in range(80, len(out), 72)]
    return "".join(f"{c:<80}" for c in (out[:80], *rest))


def _padded(data: bytes, fill: bytes = b"\0") -> bytes:
    return data + fill * (-len(data) % BLOCK)


def header(cards_: list[str]) -> bytes:
    return _padded("".join([*cards_, f"{'END':<80}"]).encode("ascii"), b" ")


def image_hdu(a: np.ndarray, kind: str, keys: list[str], first: bool) -> bytes:
    """An image unit: axes are (channels,) width, height, as stored."""
    bits, zero, _ = TYPES[kind]
    axes = [n for n in reversed(a.shape)]
    lines = [header_card("SIMPLE", True) if first else header_card("XTENSION", "IMAGE"), header_card("BITPIX", bits), header_card("NAXIS", len(axes))]
    lines += [header_card(f"NAXIS{i}", n) for i, n in enumerate(axes, 1)]
    lines += [header_card("EXTEND", True)] if first else [header_card("PCOUNT", 0), header_card("GCOUNT", 1), header_card("EXTNAME", "IMAGE")]
    if zero:
        lines += [header_card("BZERO", zero), header_card("BSCALE", 1)]
    return header(lines + keys) + _padded(_stored(a, kind))


def _stored(a: np.ndarray, kind: str) -> bytes:
    _, zero, store = TYPES[kind]
    a = np.ascontiguousarray(a, store)
    if zero:
        word = f"u{a.itemsize}"
        a = a.view(word) ^ np.array(1 << (8 * a.itemsize - 1), word)
    return a.astype(a.dtype.newbyteorder(">")).tobytes()


def _unstored(raw: bytes, kind: str) -> np.ndarray:
    _, zero, store = TYPES[kind]
    if not zero:
        return np.frombuffer(raw, f">{store}").astype(store)
    word = f"u{np.dtype(store).itemsize}"
    a = np.frombuffer(raw, f">{word}").astype(word)
    return (a ^ np.array(1 << (8 * a.itemsize - 1), word)).view(store)


#: what a compression is called in the header
ALGORITHMS = {"gzip": "GZIP_1", "rice": "RICE_1"}


def _tile(row: np.ndarray, kind: str, compression: str) -> bytes:
    raw = _stored(row, kind)
    if compression == "gzip":
        return gzip.compress(raw, mtime=0)
    bits = TYPES[kind][0]
    return rice.encode(np.frombuffer(raw, f">{'u' if bits == 8 else 'i'}{bits // 8}").astype(f"{'u' if bits == 8 else 'i'}{bits // 8}"))


def tiled_hdu(a: np.ndarray, kind: str, keys: list[str], compression: str) -> bytes:
    """A tiled-image table: each row of pixels is a compressed stream in the heap."""
    bits, zero, _ = TYPES[kind]
    if compression == "rice" and bits not in (8, 16, 32):
        raise ValueError(f"Compression rice takes no {kind} pixels; use none or gzip")
    flat = a.reshape(a.shape[0], -1)
    tiles = [_tile(row, kind, compression) for row in flat]
    sizes = np.array([len(t) for t in tiles])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    table = np.stack([sizes, offsets], axis=1).astype(">i4").tobytes()
    axes = [n for n in reversed(a.shape)]
    lines = [header_card("XTENSION", "BINTABLE"), header_card("BITPIX", 8), header_card("NAXIS", 2), header_card("NAXIS1", 8), header_card("NAXIS2", len(tiles)), header_card("PCOUNT", int(sizes.sum())), header_card("GCOUNT", 1), header_card("TFIELDS", 1)]
    lines += [header_card("TTYPE1", "COMPRESSED_DATA"), header_card("TFORM1", f"1PB({sizes.max()})"), header_card("ZIMAGE", True), header_card("ZBITPIX", bits), header_card("ZNAXIS", len(axes)), header_card("ZCMPTYPE", ALGORITHMS[compression]), header_card("EXTNAME", "IMAGE")]
    # a tile is a row of pixels with all their channels
    whole = len(axes) - 1
    for i, n in enumerate(axes, 1):
        lines += [header_card(f"ZNAXIS{i}", n), header_card(f"ZTILE{i}", n if i <= whole else 1)]
    if compression == "rice":
        lines += [header_card("ZNAME1", "BLOCKSIZE"), header_card("ZVAL1", rice.BLOCK), header_card("ZNAME2", "BYTEPIX"), header_card("ZVAL2", bits // 8)]
    if zero:
        lines += [header_card("BZERO", zero), header_card("BSCALE", 1)]
    return header(lines + keys) + _padded(table + b"".join(tiles))


def metadata_cards(row: dict) -> list[str]:
    """The cards of one image, as ``cards`` gives them."""
    meta = dict(row.get("metadata") or {})
    stamp = meta.get("TIMESTAMP", {}).get("ns") or 0
    if stamp < 0:
        raise ValueError("the time stamp is before the epoch")
    when = datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=stamp // 1000)
    out = [header_card("DATE-OBS", when.strftime("%Y-%m-%dT%H:%M:%S.%f")), header_card("COLOR_SPACE", ColorSpace.of(row["cspace"]).text())]
    for key, m in sorted(meta.items()):
        kind, note = m["kind"], m["comment"]
        if kind in ("duration", "systemtime"):
            seconds, rest = divmod(m["ns"], NANOS)
            since = " from EPOCH" if kind == "systemtime" else ""
            label = lambda unit: f"{note} ({unit}{since})" if note else f"{unit}{since}" if since else f"({unit})"
            out += [header_card(f"{key}_S", seconds, label("s")), header_card(f"{key}_NS", rest, label("ns"))]
            if kind == "duration" or not note:
                out.append(header_card(key, seconds + rest / 1e9, note or f"s{since}"))
        else:
            value = next(m[s] for s in ("i", "u", "f", "s") if m[s] is not None)
            out.append(header_card(key, int(value) if kind[0] in "ui" else value, note))
    return out


def pixels_of(row: dict) -> np.ndarray:
    kind = "<" + TYPES[row["pixel_type"]][2]
    shape = (row["height"], row["width"]) + ((row["channels"],) if row["channels"] > 1 else ())
    return np.frombuffer(row["data"], kind).reshape(shape)


def file_bytes(row: dict, compression: str = "none") -> bytes:
    a, kind, keys = pixels_of(row), row["pixel_type"], metadata_cards(row)
    if compression == "none":
        return image_hdu(a, kind, keys, True)
    if compression not in ALGORITHMS:
        raise ValueError(f"Compression {compression} is not available; use none, gzip or rice")
    empty = [header_card("SIMPLE", True), header_card("BITPIX", 8), header_card("NAXIS", 0), header_card("EXTEND", True)]
    return header(empty + keys) + tiled_hdu(a, kind, keys, compression)


def open_fs(path: str):
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class Written(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class FitsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.compression = options.get("compression", "none").lower()
        self.append = options.get("append", "false").lower() == "true"
        if self.compression not in ("none", *ALGORITHMS):
            raise ValueError(f"Compression {self.compression} is not available; use none, gzip or rice")

    def write(self, iterator):
        filesystem, folder = open_fs(self.path)
        task = f"{folder}/_attempts/{uuid.uuid4().hex}"
        filesystem.create_dir(task, recursive=True)
        names, stream = [], None
        for row in image_rows(iterator):
            if not self.append:
                name = f"{row['image_id']}.fits"
                with filesystem.open_output_stream(f"{task}/{name}", compression=None) as out:
                    out.write(file_bytes(row, self.compression))
                names.append((f"{task}/{name}", name))
                continue
            if stream is None:
                name = f"part-{uuid.uuid4().hex}.fits"
                names.append((f"{task}/{name}", name))
                stream = filesystem.open_output_stream(names[0][0], compression=None)
                stream.write(header([header_card("SIMPLE", True), header_card("BITPIX", 8), header_card("NAXIS", 0), header_card("EXTEND", True)]))
            unit = (pixels_of(row), row["pixel_type"], metadata_cards(row))
            stream.write(image_hdu(*unit, False) if self.compression == "none" else tiled_hdu(*unit, self.compression))
        if stream:
            stream.close()
        return Written(names)

    def commit(self, messages):
        filesystem, folder = open_fs(self.path)
        if self.overwrite:  # files of other names belong to the table that is replaced
            for x in filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if x.path.endswith(".fits"):
                    filesystem.delete_file(x.path)
        for source, name in (x for m in messages if m for x in m.names):
            there = filesystem.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound
            if there:
                raise FileExistsError(f"{name} exists; write with mode overwrite")
            filesystem.move(source, f"{folder}/{name}")
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        filesystem, folder = open_fs(self.path)
        filesystem.create_dir(f"{folder}/_attempts", recursive=True)
        filesystem.delete_dir(f"{folder}/_attempts")


def _value(text: str):
    if text[0] == "'":
        return text[1:-1].replace("''", "'").rstrip()
    return text == "T" if text in "TF" else float(text) if re.search(r"[.EN]", text) else int(text)


def read_header(stream) -> dict | None:
    """The next header's keys, up to its last block; None at the end of the file."""
    keys, last, open_ = {}, None, False
    while True:
        block = stream.read(BLOCK)
        if not block:
            return None
        for i in range(0, BLOCK, 80):
            card = bytes(block[i : i + 80]).decode("ascii")
            if card.startswith("END") and not card[3:].strip():
                return keys
            if card.startswith("CONTINUE"):
                m = re.match(r"CONTINUE\s+('(?:[^']|'')*')", card)
                if m and open_:
                    more = _value(m[1])
                    open_ = more.endswith("&")
                    keys[last] += more[:-1] if open_ else more
                continue
            if open_:
                keys[last] += "&"  # the value itself ends in one
            m, open_ = re.match(r"(?:HIERARCH )?([^=]+?)\s*= *('(?:[^']|'')*'|[^/ ]+)", card), False
            if m and not card.startswith("COMMENT"):
                last = m[1].strip()
                value = _value(m[2])
                open_ = isinstance(value, str) and value.endswith("&")
                keys[last] = value[:-1] if open_ else value


def unit_bytes(keys: dict) -> int:
    return abs(keys["BITPIX"]) // 8 * int(np.prod([keys[f"NAXIS{i}"] for i in range(1, keys["NAXIS"] + 1)] or [0])) + keys.get("PCOUNT", 0)


def read_image(data: bytes, keys: dict) -> tuple[np.ndarray, str] | None:
    """The pixels and pixel type of a unit, if it is an image."""
    z = "Z" if keys.get("ZIMAGE") else ""
    if keys.get("XTENSION", "").strip() == "BINTABLE" and not z or not keys.get(f"{z}NAXIS"):
        return None
    shape = [keys[f"{z}NAXIS{i}"] for i in range(keys[f"{z}NAXIS"], 0, -1)]
    kind = next(k for k, (b, o, _) in TYPES.items() if (b, o) == (keys[f"{z}BITPIX"], keys.get("BZERO", 0)))
    if z:
        table = np.frombuffer(data, ">i4", 2 * shape[0]).reshape(-1, 2)
        heap = 8 * shape[0]
        tiles = [data[heap + offset : heap + offset + size] for size, offset in table]
        if keys["ZCMPTYPE"].strip() == "RICE_1":
            word = f"{'u' if keys['ZBITPIX'] == 8 else 'i'}{keys['ZBITPIX'] // 8}"
            tiles = [rice.decode(t, int(np.prod(shape[1:])), word).astype(f">{word}").tobytes() for t in tiles]
        else:
            tiles = [gzip.decompress(t) for t in tiles]
        data = b"".join(tiles)
    return _unstored(data, kind).reshape(shape), kind


#: units to a batch that is read, and bytes of pixels after which it ends; Spark would gather 10,000 of any size
UNITS, UNIT_BYTES = 256, 4 << 20

ROWS = pa.schema(
    [("path", pa.string()), ("unit", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixel_type", pa.string()), ("data", pa.binary()), ("color_space", pa.string()), ("keys", pa.map_(pa.string(), pa.string()))]
)


def batched(rows):
    """Arrow batches of read units, each small whatever the images' number and size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6])
        if len(held) == UNITS or size >= UNIT_BYTES:
            yield _rows_batch(held)
            held, size = [], 0
    if held:
        yield _rows_batch(held)


def _rows_batch(rows) -> pa.RecordBatch:
    *columns, keys = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, [list(k.items()) for k in keys]], ROWS, strict=True)], schema=ROWS)


class Files(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class FitsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("maxpartitionbytes", 1 << 26))

    def partitions(self):
        filesystem, folder = open_fs(self.path)
        found = [x for x in filesystem.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.path.endswith(".fits")]
        out, own, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if own and size + f.size > self.limit:
                out.append(Files(own))
                own, size = [], 0
            own.append(f.path)
            size += f.size
        return [*out, Files(own)] if own or not out else out

    def read(self, partition):
        return batched(self.units(partition))

    def units(self, partition):
        """A unit at a time: no file is held whole."""
        filesystem, _ = open_fs(self.path)
        for path in partition.paths:
            with filesystem.open_input_stream(path, compression=None) as stream:
                n = 0
                while (keys := read_header(stream)) is not None:
                    size = unit_bytes(keys)
                    data = stream.read(size + -size % BLOCK)[:size]
                    image = read_image(data, keys)
                    if image:
                        a, kind = image
                        yield path, n, a.shape[1], a.shape[0], a.shape[2] if a.ndim > 2 else 1, kind, a.astype(a.dtype.newbyteorder("<")).tobytes(), str(keys.get("COLOR_SPACE", "")), {k: str(v) for k, v in keys.items()}
                    n += 1


class FitsSource(DataSource):
    @classmethod
    def name(cls):
        return "fits"

    def schema(self):
        return "path string, unit int, width int, height int, channels int, pixel_type string, data binary, color_space string, keys map<string,string>"

    def reader(self, schema):
        return FitsReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        return FitsWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark) -> None:
    spark.dataSource.register(FitsSource)


def write_fits(images: DataFrame, path: str, compression: str = "none", overwrite: bool = True, append: bool = False) -> None:
    """Write image rows (with ``metadata``) as FITS files under ``path``."""
    register(images.sparkSession)
    images.write.format("fits").option("compression", compression).option("append", str(append)).mode("overwrite" if overwrite else "append").save(path)


def read_fits(spark, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("fits").load(path)
