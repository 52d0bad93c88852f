import gzip
import hashlib
import base64
import io
import os

import pytest
from pyspark.sql import functions as F

from lumigrid.llm import warc

PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4\r\nX: y", ""), (5, "http://a/5", "WARC/1.1\r\n\r\n" * 50), (6, "http://a/6", "x" * 3_000_000), (0, "http://a/0", "<p>é</p>"), (7, "u", "x" * 3_000_000)]


def wanted(pages, least):
    first = {}
    for i, _, html in sorted(pages):
        first.setdefault(html or "", i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        again = len(raw) >= least and first[html or ""] != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None, None if again else raw))
    return sorted(out)


def back(df):
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).cast("long")
    rows = df.select(number(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")), "payload").collect()
    return sorted((*r[:5], bytes(r[5]) if r[5] is not None else None) for r in rows)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    for least in (0, 5):
        path = f"file://{tmp_path}/{least}"
        warc.write_archives(pages.repartition(3), path, min_bytes=least, maxFileBytes=2000)
        assert back(warc.read_archives(spark, path)) == wanted(PAGES, least)
        assert warc.verified(warc.read_archives(spark, path)).where("not intact").count() == 0
    files = [f for f in os.listdir(tmp_path / "0")]
    assert all(f.endswith(".warc.gz") for f in files) and len(files) >= 2


def test_filters_and_columns_skip_payloads(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    heads = warc.read_archives(spark, path, "record_id string, record_type string").where("record_type = 'revisit'")
    assert {r.record_id for r in heads.collect()} == {"<urn:page:1>", "<urn:page:2>", "<urn:page:4>", "<urn:page:7>"}
    one = warc.read_archives(spark, path).where(F.col("record_id").isin("<urn:page:5>"))
    assert bytes(one.first().payload).decode() == PAGES[4][2]
    reader = warc.WarcReader(heads.select("record_id", "record_type").schema, {"path": path})
    from pyspark.sql.datasource import EqualTo, IsNotNull

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), IsNotNull(("record_type",))]))
    assert reader.tests == {"record_type": {"revisit"}} and len(rest) == 1


def test_unwanted_blocks_are_not_decoded(tmp_path):
    rows = [dict(record_id=f"<urn:{k}>", record_type="response", target_uri="u", refers_to=None, payload_digest="D", payload=b"p" * 10) for k in range(3)]
    data = b"".join(warc.record_bytes(r) for r in rows)
    for zipped in (False, True):
        raw = b"".join(gzip.compress(warc.record_bytes(r)) for r in rows) if zipped else data
        seen = list(warc.records(io.BytesIO(raw), zipped, lambda f: f["warc-record-id"] == "<urn:1>", True))
        assert [p for _, p in seen] == [b"p" * 10]
        assert [p for _, p in warc.records(io.BytesIO(raw), zipped, lambda f: True, False)] == [None] * 3


def test_small_files_share_a_partition(spark, tmp_path):
    path = str(tmp_path / "many")
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(4), path, maxFileBytes=1)
    n = len(os.listdir(path))
    assert n == len(PAGES)
    assert warc.read_archives(spark, path).rdd.getNumPartitions() == 1
    assert warc.read_archives(spark, path, maxPartitionBytes=1).rdd.getNumPartitions() == n


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


FOREIGN = (
    b"WARC/1.0\r\nwarc-type:RESPONSE\r\nWARC-RECORD-ID: <urn:a>\r\nWARC-Target-URI:\thttp://x/\r\n  y\r\ncontent-length:32\r\nContent-Type:application/http;msgtype=response\r\n\r\n"
    b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello\r\n\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:b>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:c>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
)


def test_archives_of_other_writers(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(FOREIGN)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(FOREIGN))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    want = [("<urn:a>", "response", "http://x/ y", 7, b"hello\r\n"), ("<urn:b>", "metadata", None, 4, b"abcd"), ("<urn:c>", "revisit", None, None, None)]
    got = [(r.record_id, r.record_type, r.target_uri, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in rows]
    assert sorted(got, key=str) == sorted(want * 2, key=str)
    heads = warc.read_archives(spark, str(tmp_path), "record_id string, payload_bytes long").where("record_id = '<urn:a>'").collect()
    assert [r.payload_bytes for r in heads] == [7, 7]


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_unwanted_blocks_of_plain_files_are_not_read():
    row = dict(record_type="response", target_uri="u", refers_to=None, payload_digest="D", payload=b"p" * 5_000_000)
    raw = b"".join(warc.record_bytes(row | {"record_id": f"<urn:{k}>"}) for k in range(4))
    stream = Counted(raw)
    seen = list(warc.records(stream, False, lambda f: f["warc-record-id"] == "<urn:2>", True))
    assert [len(p) for _, p in seen] == [5_000_000] and stream.taken < 10_000_000
    for cut in (len(raw) - 10, 2_000_000):
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.records(io.BytesIO(raw[:cut]), False, lambda f: False, False))


def test_many_copies_are_joined_by_id(spark):
    pages = [(i, "u", f"p{i % 7}".encode()) for i in range(60)] + [(None, "u", b"p1"), (None, "u", b"p1"), (3, "u", b"p3"), (3, "u", b"p2")]
    df = spark.createDataFrame(pages, "page_id long, url string, payload binary")
    key = lambda r: tuple((x is None, x) for x in r)
    out = [sorted((tuple(r) for r in warc.with_revisits(df, broadcast=n).drop("payload").collect()), key=key) for n in (1000, 0)]
    assert out[0] == out[1] and len(out[0]) == len(pages)
    kinds = [r for r in out[0] if r[0] == "<urn:page:3>"]
    assert sorted(r[1] for r in kinds) == ["response", "response", "revisit"]


def test_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a", "x", "y", 5)], "page_id long, url string, html string, digest string, first string, n int")
    warc.write_archives(df, str(tmp_path / "c"))
    assert [r.record_type for r in warc.read_archives(spark, str(tmp_path / "c")).collect()] == ["response"]
