"""Line dedup: a line goes if an earlier line of the corpus is equal or one edit away.

Lines are compared trimmed; lines without a word stay, and those under
``min_chars`` characters go only if they are equal to an earlier one, since one
edit makes another word of a short line. The order is (doc_id, line number).
"Earlier" includes lines that go themselves, so the result does not depend on
the order of work.

Two lines are within one edit exactly if deleting at most one character makes
them equal: deleting the same place of both (a changed character), or one place
of the longer (an inserted one). Variants are emitted as hashed keys in two
grains, so that only lines with a near partner emit one per character:

1. Equal lines are merged into their earliest.
2. Blocks: a line is cut in ``blocks`` parts by its own length, and by the
   length less one; each part left out in turn gives a key. Lines within one
   edit share a key, the one without the edited part.
3. Characters: for a shared key, the variants that delete one character of the
   part left out. Among lines with the same variant at the same place all are
   within one edit, and the earliest is known from one minimum per key; a line
   that equals a variant is paired with the lines that it is a variant of.
4. Each near line is verified against its earlier partner by edit distance.

No step makes pairs inside a group: each key carries minima only.

Defined cases: null text stays null; documents with no line left get an empty
text (``dedup_lines`` keeps them, ``kept`` false); a null doc_id counts as the
smallest; rows that share a doc_id, or have none, are documents of their own, in
the order of their texts' hashes (equal rows: as they come, all but one go); an
empty table gives no rows; other columns pass through, and input columns of the
result's names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as T
from .store import cut, cut_counting

U = np.uint64
#: what strip() takes from a line's ends
BLANKS = np.zeros(0x110000, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class LineDedup:
    max_edits: int = 1
    #: shortest line that one edit may match
    min_chars: int = 10
    blocks: int = 4

    def __post_init__(self):
        if self.max_edits not in (0, 1):
            raise ValueError(f"max_edits is 0 or 1, not {self.max_edits}: the neighbourhoods are those of one edit")


def lines_of(data: np.ndarray, offsets: np.ndarray):
    """Code points of all rows, and per line: row, number in the row, trimmed start and end."""
    raw = data.tobytes()
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    # a row's first code point: how many lead bytes stand before it
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    rows = lead[offsets]
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(codes == 10)
    start = np.sort(np.concatenate([rows[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([rows[1:], breaks]), kind="stable")
    row = np.repeat(np.arange(n_rows), 1 + np.diff(np.searchsorted(breaks, rows)))
    first = np.searchsorted(row, np.arange(n_rows))
    number = np.arange(len(row)) - first[row]
    solid = np.flatnonzero(~BLANKS[codes]) if len(codes) else np.zeros(0, np.int64)
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    has = a < b
    safe = solid if len(solid) else np.zeros(1, np.int64)
    lo = np.where(has, safe[np.minimum(a, len(safe) - 1)], start)
    hi = np.where(has, safe[np.maximum(b - 1, 0)] + 1, start)
    return codes, row, number, lo, hi


def line_hash(ph: T.PrefixHash, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return T.mix(ph.of(lo, hi) + (hi - lo).astype(U) * U(0x9E3779B97F4A7C15))


def codes_hash(codes: np.ndarray) -> T.PrefixHash:
    return T.PrefixHash(T.mix(codes.astype(U) + U(1)))


def cuts(length: np.ndarray, blocks: int) -> np.ndarray:
    """(lines, blocks + 1) bounds of the parts of lines of these lengths."""
    return (length[:, None] * np.arange(blocks + 1)[None, :]) // blocks


def block_keys(ph: T.PrefixHash, lo: np.ndarray, hi: np.ndarray, blocks: int) -> np.ndarray:
    """(lines, 2 * blocks): keys by the line's own length, then by the length less one."""
    size, out = hi - lo, []
    for less in (0, 1):
        bounds = cuts(size - less, blocks)
        for s in range(blocks):
            head, tail = lo + bounds[:, s], lo + bounds[:, s + 1] + less
            rest = ph.of(lo, head) + ph.of(tail, hi) * T.shifted(head - lo)
            out.append(T.mix(rest * U(2 * s + 3) + (size - less).astype(U) * U(0xD6E8FEB86659FD93) + U(s)))
    return np.stack(out, axis=1)


LINE = "h long, id long, tie long, line int, keys array<long>"
#: where a line stands, in the order of what is earlier
PLACE = ["id", "tie", "line"]
#: stands for a null doc_id
FIRST = -(1 << 63)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with id and tie, which together are one row's own and give the rows' order.

    Where a doc_id is unique the tie is 0. The other rows are written in the order
    of (doc_id, text), so their numbers are the same whenever they are read."""
    number = F.col("doc_id").cast("long")
    shared = docs.groupBy(number.alias("shared")).count().where("count > 1 or shared is null").select("shared")
    shared, n = cut_counting(shared, "shared")
    docs = docs.withColumn("id", F.coalesce(number, F.lit(FIRST)))
    if not n:
        return docs.withColumn("tie", F.lit(0).cast("long"))
    one = docs.where("doc_id is not null").join(shared, number == F.col("shared"), "left_anti").withColumn("tie", F.lit(0).cast("long"))
    some = docs.join(shared, number.eqNullSafe(F.col("shared")), "left_semi").repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return one.unionByName(cut(some.withColumn("tie", F.monotonically_increasing_id() + 1), "repeated"))


def _distinct_lines(docs: DataFrame, p: LineDedup) -> DataFrame:
    def run(batches):
        for rows, data, offsets in T.pieces(batches, "text", 2 << 20):
            codes, row, number, lo, hi = lines_of(data, offsets)
            use = np.flatnonzero(hi > lo)
            if not len(use):
                continue
            lo, hi, ph = lo[use], hi[use], codes_hash(codes)
            h = line_hash(ph, lo, hi)
            col = lambda n: rows.column(rows.schema.get_field_index(n)).to_numpy(zero_copy_only=False)[row[use]]
            ids, ties, number = col("id"), col("tie"), number[use]
            # the earliest of equal lines of this piece stands for them
            order = np.lexsort((number, ties, ids, h))
            one = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])]
            long = (hi[one] - lo[one] >= p.min_chars) & (p.max_edits > 0)
            keys = block_keys(ph, lo[one][long], hi[one][long], p.blocks).view(np.int64)
            bounds = np.concatenate([[0], np.cumsum(long * keys.shape[1])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.ravel()))
            at = [pa.array(x) for x in (h[one].view(np.int64), ids[one], ties[one], number[one].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*at, lists], names=["h", "id", "tie", "line", "keys"])

    each = docs.select("id", "tie", "text").mapInArrow(run, LINE)
    # keys follow from the line, so any of equal lines' keys will do
    return each.groupBy("h").agg(F.min(F.struct(*PLACE)).alias("at"), F.first("keys").alias("keys")).select("h", "at.id", "at.tie", "at.line", "keys")


def _variant_rows(lines: DataFrame, p: LineDedup) -> DataFrame:
    """lines: h, id, tie, line, body, parts (which of the 2 * blocks keys are shared).

    Rows (variant, place, h, id, tie, line): place is where a character was
    deleted, -1 for the whole line."""

    def run(batches):
        for rows, data, offsets in T.pieces(batches, "body", 1 << 20):
            raw = data.tobytes().decode("utf-8")
            codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            ph = codes_hash(codes)
            parts = rows.column(rows.schema.get_field_index("parts")).to_pylist()
            line, place = [], []
            for i, own in enumerate(parts):
                size = int(at[i + 1] - at[i])
                spots = {-1}
                for k in own:
                    less, s = divmod(k, p.blocks)
                    n = size - less
                    spots.update(range(n * s // p.blocks, n * (s + 1) // p.blocks + less))
                place += sorted(spots)
                line += [i] * len(spots)
            line, place = np.array(line), np.array(place)
            lo, hi = at[line], at[line + 1]
            gap = lo + np.maximum(place, 0)
            after = np.where(place < 0, gap, gap + 1)
            whole = ph.of(lo, gap) + ph.of(after, hi) * T.shifted(gap - lo)
            variant = T.mix(whole + (hi - lo - (place >= 0)).astype(U) * U(0x9E3779B97F4A7C15))
            take = lambda n: rows.column(rows.schema.get_field_index(n)).take(pa.array(line))
            yield pa.RecordBatch.from_arrays([pa.array(variant.view(np.int64)), pa.array(place.astype(np.int32)), *[take(n) for n in ("h", *PLACE)]], names=["variant", "place", "h", *PLACE])

    return lines.select("h", *PLACE, "body", "parts").mapInArrow(run, "variant long, place int, h long, id long, tie long, line int")


def within_one_edit(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (h, id, tie, line, parts) with the trimmed line as body."""
    # a list holds lines of one text, so it is no longer than that
    lists = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("line", "h", "parts")).alias("wanted"))
    own = docs.select("id", "tie", "text").join(lists, ["id", "tie"])

    def run(batches):
        for rows, data, offsets in T.pieces(batches, "text", 1 << 20):
            codes, row, _, lo, hi = lines_of(data, offsets)
            first = np.searchsorted(row, np.arange(len(offsets)))
            out = {"h": [], "id": [], "tie": [], "line": [], "body": [], "parts": []}
            col = lambda n: rows.column(rows.schema.get_field_index(n)).to_pylist()
            for r, (own, id_, tie) in enumerate(zip(col("wanted"), col("id"), col("tie"), strict=True)):
                for w in own:
                    at = first[r] + w["line"]
                    body = codes[lo[at] : hi[at]].tobytes().decode("utf-32-le", "surrogatepass")
                    for k, v in zip(out, (w["h"], id_, tie, w["line"], body, w["parts"]), strict=True):
                        out[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return own.mapInArrow(run, "h long, id long, tie long, line int, body string, parts array<int>")


def near_lines(docs: DataFrame, lines: DataFrame, p: LineDedup) -> DataFrame:
    """h of the distinct lines that have an earlier line one edit away."""
    keys = lines.select("h", F.posexplode("keys").alias("part", "key"))
    # a key of the own length in one line, and any other line with that key
    crowd = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("least")).where(f"n > 1 and least < {p.blocks}")
    shared = keys.join(crowd.select("key"), "key", "left_semi").groupBy("h").agg(F.collect_set("part").alias("parts"))
    wanted = lines.select("h", *PLACE).join(shared, "h")
    bodies = cut(_bodies(docs, wanted), "bodies")
    variants = cut(_variant_rows(bodies, p), "variants")
    at = F.struct(*PLACE, "h")
    # a character changed: same variant, same place
    changed = variants.where("place >= 0").groupBy("variant", "place").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = variants.where("place >= 0").join(changed, ["variant", "place"]).where(at > F.col("first")).select("h", F.col("first.h").alias("other"))
    # a character inserted: whole lines that are variants of longer ones
    groups = variants.groupBy("variant").agg(
        F.min(F.when(F.col("place") < 0, at)).alias("short"), F.min(F.when(F.col("place") >= 0, at)).alias("long")
    ).where("short is not null and long is not null")
    both = variants.join(groups, "variant")
    pairs = pairs.unionByName(both.where("place < 0").where(at > F.col("long")).select("h", F.col("long.h").alias("other")))
    pairs = pairs.unionByName(both.where("place >= 0").where(at > F.col("short")).select("h", F.col("short.h").alias("other")))
    pairs = pairs.distinct()
    side = lambda n, b: bodies.select(F.col("h").alias(n), F.col("body").alias(b))
    near = pairs.join(side("h", "own"), "h").join(side("other", "theirs"), "other")

    def verify(batches):
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            ok = [within_one_edit(a, b) for a, b in zip(col("own").to_pylist(), col("theirs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([col("h").filter(pa.array(ok, pa.bool_()))], names=["h"])

    return near.select("h", "own", "theirs").mapInArrow(verify, "h long").distinct()


def dedup_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """``docs`` with text reduced to the lines that stay, and n_lines,
    n_removed (lines that went) and kept (false if no word is left of a text
    that had some, by lines going)."""
    docs = docs.drop("n_lines", "n_removed", "kept")
    names = docs.columns
    # every column but the text travels under a number, so that no name can clash
    rest = [n for n in names if n != "text"]
    plain = docs.select(F.col("doc_id"), F.col("text"), *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(rest)])
    own = numbered(plain)
    lines = cut(_distinct_lines(own, p), "lines")
    stay = lines.select("h", *PLACE)
    if p.max_edits:
        stay = stay.join(near_lines(own, lines, p), "h", "left_anti")
    lists = stay.groupBy("id", "tie").agg(F.collect_list("line").alias("stay"))
    own = own.join(lists, ["id", "tie"], "left")
    order = ["text" if n == "text" else f"c{rest.index(n)}" for n in names]
    own = own.select(*[F.col(c).alias(f"o{i}") if c != "text" else F.col(c) for i, c in enumerate(order)], "stay")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_lines long, n_removed long, kept boolean").fields])

    def run(batches):
        for rows, data, offsets in T.pieces(batches, "text", 1 << 20):
            _, row, _, lo, hi = lines_of(data, offsets)
            col = lambda n: rows.column(rows.schema.get_field_index(n))
            worded = hi > lo
            keep = ~worded
            sizes = pc.fill_null(pc.list_value_length(col("stay")), 0).to_numpy(zero_copy_only=False)
            first = np.searchsorted(row, np.arange(len(offsets)))
            lines_left = pc.list_flatten(col("stay")).to_numpy(zero_copy_only=False).astype(np.int64)
            keep[first[np.repeat(np.arange(len(sizes)), sizes)] + lines_left] = True
            n_rows = len(offsets) - 1
            removed = np.bincount(row[~keep], minlength=n_rows)
            texts = col("text")
            left = np.bincount(row[keep & worded], minlength=n_rows) > 0
            if removed.any():
                new = texts.to_pylist()
                for r in np.flatnonzero(removed):
                    whole = new[r].split("\n")
                    new[r] = "\n".join([x for x, k in zip(whole, keep[first[r] : first[r + 1]], strict=True) if k])
                texts = pa.array(new, pa.string())
            columns = [texts if n == "text" else col(f"o{i}") for i, n in enumerate(names)]
            n_lines = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.diff(first), 0)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(removed.astype(np.int64)), pa.array((removed == 0) | left)], names=[*names, "n_lines", "n_removed", "kept"])

    return own.mapInArrow(run, schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", "kept", F.length("text").cast("long").alias("chars_left"), F.sha1(F.encode("text", "utf-8")).alias("text_sha1"))


#: the same by every deletion variant of every line; for small tables whose ids are unique
SQL = """
WITH y AS (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
z AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b, doc_id::HUGEINT * 4294967296 + k AS place FROM y),
f AS (SELECT b, min(place) AS place FROM z WHERE b <> '' GROUP BY b),
g AS (SELECT b, place, length(b) AS n FROM f WHERE length(b) >= 10),
s AS (SELECT n, count(*) AS c FROM g GROUP BY n),
c AS (SELECT g.* FROM g WHERE n IN (SELECT n FROM s WHERE c > 1) OR n + 1 IN (SELECT n FROM s) OR n - 1 IN (SELECT n FROM s)),
v AS (SELECT b, place, p, hash(substr(b, 1, p) || substr(b, p + 2)) AS h FROM (SELECT b, place, unnest(range(n)) AS p FROM c)),
w AS (SELECT b, place, hash(b) AS h FROM c),
changed AS (SELECT v.b FROM v JOIN (SELECT h, p, min(place) AS m FROM v GROUP BY ALL) o ON v.h = o.h AND v.p = o.p WHERE v.place > o.m),
longer AS (SELECT v.b FROM v JOIN w ON v.h = w.h WHERE v.place > w.place),
shorter AS (SELECT w.b FROM w JOIN (SELECT h, min(place) AS m FROM v GROUP BY h) o ON w.h = o.h WHERE w.place > o.m),
near AS (SELECT b FROM changed UNION SELECT b FROM longer UNION SELECT b FROM shorter),
stay AS (SELECT z.*, z.b = '' OR (z.place = f.place AND near.b IS NULL) AS stays FROM z LEFT JOIN f ON z.b = f.b LEFT JOIN near ON z.b = near.b),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, bool_or(stays AND b <> '') AS worded, coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (stays), '') AS text FROM stay GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_removed = 0 OR worded, true) AS kept, length(t.text) AS chars_left, sha1(t.text) AS text_sha1
FROM documents d LEFT JOIN t USING (doc_id)"""
