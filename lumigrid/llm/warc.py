"""WARC archives: a Python data source that writes and reads them.

Reading plans partitions of whole files, small ones together up to
``maxPartitionBytes``. Filters on record_type, record_id, target_uri and
payload_digest are taken over by the source: a record's headers are parsed
first, and the block of a record that fails, or whose payload the schema does
not ask for, is skipped by its length. In a plain file that is a seek; in a gzip
file, one member per record, the member must still be inflated to find its end,
but nothing of it is kept or decoded. Files are opened through pyarrow's file
systems, so local, HDFS and object-store paths work alike.

Field names are read in any case, with or without a blank behind the colon, and
folded values are joined, so other writers' archives are read too. Their
payload_bytes are counted from the block if no header states them.

Writing rolls files over at ``maxFileBytes``; a task writes under a name of its
own attempt and only the commit gives files their final names, so a lost
executor leaves no half-written archive.

Defined cases: a null payload is written as an empty one; a payload of a revisit
record is null when read; rows that share a page_id are separate records, and
equal ones among them all responses; an empty table gives an empty folder of
archives; other columns of the pages are not read. An archive that ends inside a
record, or a record without a length, is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .store import cut_counting, new_path

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
FILTERED = {"record_id", "record_type", "target_uri", "payload_digest"}
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "WARC-Payload-Length",
}
LENGTH = FIELDS["payload_bytes"].lower()
ENDS = "the archive ends inside a record"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def record_bytes(row: dict) -> bytes:
    payload = row["payload"] or b""
    kind = row["record_type"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if kind == "revisit" else payload)
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": row["record_id"],
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Refers-To": row["refers_to"] if kind == "revisit" else None,
        "WARC-Profile": REVISIT if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


@dataclass
class Files(WriterCommitMessage):
    names: list
    rows: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("maxfilebytes", 1 << 28))
        self.level = int(options.get("level", 1))

    def write(self, iterator):
        filesystem, folder = open_fs(self.path)
        filesystem.create_dir(f"{folder}/_attempts", recursive=True)
        names, rows, out, size = [], 0, None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.limit:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = filesystem.open_output_stream(f"{folder}/_attempts/{names[-1]}", compression=None), 0
                packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(row)) + packer.flush()
                out.write(member)
                size += len(member)
                rows += 1
        if out:
            out.close()
        return Files(names, rows)

    def commit(self, messages):
        filesystem, folder = open_fs(self.path)
        filesystem.create_dir(folder, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                filesystem.move(f"{folder}/_attempts/{name}", f"{folder}/{name}")
        filesystem.create_dir(f"{folder}/_attempts", recursive=True)
        filesystem.delete_dir(f"{folder}/_attempts")

    def abort(self, messages):
        filesystem, folder = open_fs(self.path)
        filesystem.create_dir(f"{folder}/_attempts", recursive=True)
        filesystem.delete_dir(f"{folder}/_attempts")


@dataclass
class Paths(InputPartition):
    paths: tuple


class Input:
    """Bytes of a plain or gzip file, member by member, read in blocks. A plain one can be sought."""

    def __init__(self, stream, zipped: bool, block: int = 1 << 20):
        self.stream, self.block, self.zipped = stream, block, zipped
        self.unzip = zlib.decompressobj(31) if zipped else None
        self.left, self.have, self.at = b"", bytearray(), 0
        if not zipped:
            stream.seek(0, 2)
            self.end = stream.tell()
            stream.seek(0)

    def skip(self, n: int) -> None:
        """Pass over n bytes; those of a plain file that are not in memory are not read."""
        inside = min(n, len(self.have) - self.at)
        self.at += inside
        n -= inside
        if self.zipped:
            self.take(n, False)
        elif n:
            if self.stream.tell() + n > self.end:
                raise ValueError(ENDS)
            self.stream.seek(n, 1)

    def _more(self) -> bool:
        raw = self.left or self.stream.read(self.block)
        self.left = b""
        if not raw:
            return False
        if not self.zipped:
            self.have += raw
            return True
        if self.unzip.eof:
            self.unzip = zlib.decompressobj(31)
        self.have += self.unzip.decompress(raw)
        self.left = self.unzip.unused_data
        return True

    def _drop(self) -> None:
        del self.have[: self.at]
        self.at = 0

    def until(self, mark: bytes) -> bytes | None:
        found = self.have.find(mark, self.at)
        while found < 0:
            self._drop()
            seen = max(0, len(self.have) - len(mark))
            if not self._more():
                return None
            found = self.have.find(mark, seen)
        out = bytes(self.have[self.at : found])
        self.at = found + len(mark)
        return out

    def take(self, n: int, want: bool = True) -> bytes | None:
        """The next n bytes; unwanted ones are passed over a block at a time."""
        parts = []
        while n:
            if self.at == len(self.have):
                self._drop()
                if not self._more():
                    raise ValueError(ENDS)
                continue
            step = min(n, len(self.have) - self.at)
            if want:
                parts.append(bytes(self.have[self.at : self.at + step]))
            self.at += step
            n -= step
        return b"".join(parts) if want else None


def header_fields(lines: list[str]) -> dict:
    """Values by lower-case field name; a line that starts with a blank continues the one before."""
    fields, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] = f"{fields[name]} {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if colon:
            fields[name] = value.strip()
    return fields


def records(stream, zipped: bool, wanted, payload: bool, length: bool = False):
    """(headers, payload or None) of the records whose headers satisfy ``wanted``.

    ``length``: fill in the payload's length where the headers don't state it."""
    source = Input(stream, zipped)
    while True:
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8", "replace").split("\r\n")
        while lines and not lines[0].startswith("WARC/"):  # blank lines between records
            lines.pop(0)
        if not lines:
            continue
        fields = header_fields(lines[1:])
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"record {fields.get('warc-record-id')} states no Content-Length")
        size, ok = int(fields["content-length"]), wanted(fields)
        full = fields.get("warc-type", "").lower() != "revisit"
        count = length and LENGTH not in fields
        if ok and full and (payload or count):
            own = _payload(source.take(size), fields)
            if count:
                fields[LENGTH] = str(len(own))
            yield fields, own if payload else None
            continue
        source.skip(size)
        if ok:
            yield fields, None


def _payload(block: bytes, fields: dict) -> bytes:
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return block
    return block.partition(b"\r\n\r\n")[2]


def values(fields: dict) -> dict:
    out = {k: fields.get(v.lower()) for k, v in FIELDS.items()}
    if out["record_type"]:
        out["record_type"] = out["record_type"].lower()
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].partition(":")[2] or out["payload_digest"]
    out["payload_bytes"] = int(out["payload_bytes"]) if out["payload_bytes"] else None
    return out


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names = [f.name for f in schema.fields]
        self.path, self.limit = options["path"], int(options.get("maxpartitionbytes", 1 << 26))
        self.tests: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in FILTERED:
                yield f
                continue
            allowed = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.tests[name] = self.tests.get(name, allowed) & allowed

    def partitions(self):
        filesystem, folder = open_fs(self.path)
        files = [x for x in filesystem.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True)) if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)]
        out, own, size = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            if own and size + f.size > self.limit:
                out.append(Paths(tuple(own)))
                own, size = [], 0
            own.append(f.path)
            size += f.size
        return [*out, Paths(tuple(own))] if own or not out else out

    def read(self, partition):
        filesystem, _ = open_fs(self.path)
        tests = [(k, v) for k, v in self.tests.items()]

        def wanted(fields: dict) -> bool:
            if not tests:
                return True
            own = values(fields)
            return all(own[k] in v for k, v in tests)

        rows, size = {n: [] for n in self.names}, 0
        for path in partition.paths:
            zipped = path.endswith(".gz")
            with filesystem.open_input_stream(path, compression=None) if zipped else filesystem.open_input_file(path) as stream:
                for fields, payload in records(stream, zipped, wanted, "payload" in self.names, "payload_bytes" in self.names):
                    own = values(fields) | {"payload": payload}
                    for n in self.names:
                        rows[n].append(own[n])
                    size += len(payload or b"") + 500
                    if size > 4 << 20:
                        yield self._batch(rows)
                        rows, size = {n: [] for n in self.names}, 0
        if size:
            yield self._batch(rows)

    def _batch(self, rows: dict) -> pa.RecordBatch:
        kind = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(rows[n], kind.get(n, pa.string())) for n in self.names], names=self.names)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_digest(payload) -> F.Column:
    """Bare upper-case base32 of the SHA-1, from its hex text: 5 hex digits make 4 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(8):
        number = F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(letters), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


#: payloads with copies whose digests are broadcast; beyond this the ids of revisits are joined by shuffle
BROADCAST_FIRSTS = 250_000


def with_revisits(pages: DataFrame, min_bytes: int = 0, broadcast: int = BROADCAST_FIRSTS) -> DataFrame:
    """(page_id, url, payload) with digest, type and, for revisits, the first page of the payload.

    Digests and ids are aggregated, payloads are not. The digests that occur
    again go to every task if they are few. If not, revisits are found among ids
    and digests, and only their ids meet the payloads: page ids are many, so a
    payload with many copies makes no hot key."""
    rows = pages.withColumn("payload_digest", base32_digest(F.col("payload")))
    ids = rows.where(F.length("payload") >= min_bytes).select("page_id", F.col("payload_digest").alias("digest"))
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    firsts, n = cut_counting(firsts.select("digest", "first"), "firsts")
    if n <= broadcast:
        out = rows.join(F.broadcast(firsts), (rows.payload_digest == firsts.digest) & (F.length("payload") >= min_bytes), "left")
    else:
        found = ids.join(firsts, "digest").where("page_id <> first").select(F.col("page_id").alias("copy"), "digest", "first").distinct()
        out = rows.join(found, (rows.page_id == found.copy) & (rows.payload_digest == found.digest) & (F.length("payload") >= min_bytes), "left")
    again = F.col("first").isNotNull() & (F.col("first") != F.col("page_id"))
    return out.select(
        F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(again, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))).alias("refers_to"),
        "payload_digest", F.length("payload").cast("long").alias("payload_bytes"), "payload",
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, **options) -> None:
    """Archive (page_id, url, html) rows; rows of one page_id are separate records."""
    register(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    with_revisits(pages.select("page_id", "url", payload.alias("payload")), min_bytes).write.format("warc").options(**options).mode("append").save(path)


def read_archives(spark, path: str, schema: str = SCHEMA, **options) -> DataFrame:
    """Records with the columns of ``schema``; without ``payload`` in it no block is decoded."""
    register(spark)
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def verified(records_: DataFrame) -> DataFrame:
    """Records with ``intact``: whether the payload has the length and digest that the headers state."""
    same = (base32_digest(F.col("payload")) == F.col("payload_digest")) & (F.length("payload") == F.col("payload_bytes"))
    return records_.withColumn("intact", F.when(F.col("record_type") == "response", same))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    out = verified(read_archives(spark, path))
    return out.select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), "intact"
    )


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d),
n AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(x, 5 * k + 1, 5) AS BIGINT)) AS v FROM f)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to,
  CASE WHEN first = page_id THEN true END AS intact
FROM n"""
