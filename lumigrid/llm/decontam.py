"""Benchmark decontamination: passages of documents that are near a benchmark item.

Distance is edits of words (runs of letters and digits, A-Z lower-cased). A
passage leaks an item of n words when it is within k = floor(max_edit * n) edits.

1. An item is cut into k + 1 pieces; a passage within k edits holds one of them
   unchanged. Item-sized windows are taken where a document holds a piece, at
   the piece's place and up to ``slack`` words beside it. This step does the
   searching, and loses nothing but windows that begin over ``slack`` words off.
2. The CGK random walk embeds windows and items in strings whose Hamming
   distance follows the edit distance: step j copies the symbol under the
   pointer, and a random bit of (j, symbol) tells whether it moves on. It moves
   in half of its steps, so somewhat under 2n steps (``live_steps``) end before a
   text of n words does, and padding is hardly ever sampled.
3. Bit-sampling LSH over the embeddings filters the windows: ``walks`` x
   ``tables`` samples of ``bits`` positions; a window is compared with items
   that share a sample. One window of a passage at the edit limit passes with a
   probability of 0.96 (150 words) to 1 (5 words), and a passage has several.
4. Candidates are verified by exact edit distance, the item against the best
   stretch of the document around the window.

The benchmark is the stated query set: it is worked through in blocks of at most
about ``block_items`` items and ``block_chars`` characters, each small enough to
send to every task. Within a block items are dealt by length, so a very long one
widens nothing but its own windows.

Defined cases: null and empty texts, of documents and of items, leak nothing;
items of fewer than 1 / max_edit words are searched for exactly; items with the
same text are each reported; repeated rows of documents, and those without a
doc_id, are each searched; items without an item_id are not reported. Other
columns of either table are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

U = np.uint64
BREAK = np.ones(256, bool)
BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LEAK = "doc_id long, item_id long, distance int, item_words int, first_word long"
PAD = U(0x7F4A7C159E3779B9)


@dataclass(frozen=True)
class Decontam:
    max_edit: float = 0.2
    walks: int = 8
    tables: int = 16
    bits: int = 3
    slack: int = 2
    longest_piece: int = 5
    block_items: int = 20_000
    block_chars: int = 20_000_000
    #: bytes of embeddings at a time
    embed_bytes: int = 32 << 20
    seed: int = 11

    def edits(self, n):
        return np.floor(np.asarray(n) * self.max_edit + 1e-9).astype(np.int64)


def live_steps(n: np.ndarray) -> np.ndarray:
    """Steps of a walk that end within n words but for two standard deviations: s / 2 + sqrt(s) = n."""
    return np.maximum(((np.sqrt(1 + 2 * np.asarray(n, float)) - 1) ** 2).astype(np.int64), 1)


def embed(windows: np.ndarray, lengths: np.ndarray, walk: int, p: Decontam) -> np.ndarray:
    """CGK strings, a row per window; windows are padded beyond their length."""
    m, width = windows.shape
    steps = int(live_steps(width))
    odd = T.mix(np.arange(1, steps + 1, dtype=U) + U((p.seed * 1000 + walk) << 20)) | U(1)
    out, at, row = np.empty((steps, m), U), np.zeros(m, np.int64), np.arange(m)
    padded = np.concatenate([windows, np.full((m, 1), PAD, U)], axis=1)
    for j in range(steps):
        symbol = padded[row, np.minimum(at, lengths)]
        out[j] = symbol
        at += ((symbol * odd[j]) >> U(63)).astype(np.int64)
    return out


def bucket_keys(windows: np.ndarray, lengths: np.ndarray, p: Decontam) -> np.ndarray:
    """(windows, walks * tables) hashed samples of each embedding; the length is part of the key."""
    rnd = np.random.default_rng(p.seed)
    keys, own = np.empty((len(windows), p.walks * p.tables), U), np.arange(len(windows))
    steps = live_steps(lengths)
    for walk in range(p.walks):
        embedded = embed(windows, lengths, walk, p)
        for table in range(p.tables):
            places = rnd.random(p.bits)
            key = T.mix(lengths.astype(U) * U(1_000_003) + U(walk * p.tables + table))
            for place in places:
                key = T.mix(key * U(3) + embedded[(place * steps).astype(np.int64), own])
            keys[:, walk * p.tables + table] = key
    return keys


def by_width(lengths: np.ndarray, p: Decontam):
    """Numbers of texts, those of like lengths together, in portions whose embeddings fit in ``embed_bytes``."""
    kind = np.frexp(lengths.astype(float))[1]
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        width = int(lengths[own].max())
        step = max(1, int(p.embed_bytes / (24 * width)))
        for lo in range(0, len(own), step):
            yield own[lo : lo + step], width


def run_hashes(h: np.ndarray, bounds: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where q words of one row stand, and their hashes."""
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(len(h)) + q <= row_end)
    total = np.full(len(at), q, U)
    for j in range(q):
        total = total * U(0x9E3779B97F4A7C15) + h[at + j]
    return at, T.mix(total)


class Lookup:
    """Hashed keys to lists of numbers, behind a bit table that turns most probes away."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.lexsort((values, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.values, self.bounds = values[order], np.append(first, len(keys))
        self.shift = U(64 - 22)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of probe, value) for every match."""
        at = np.flatnonzero(self.maybe[(probes >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], self.values[:0]
        slot = np.searchsorted(self.keys, probes[at])
        slot[slot == len(self.keys)] = 0
        ok = self.keys[slot] == probes[at]
        at, slot = at[ok], slot[ok]
        n = self.bounds[slot + 1] - self.bounds[slot]
        start = np.repeat(self.bounds[slot], n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.values[start + within]


class Index:
    """The items of one block: pieces, embeddings' buckets and words."""

    def __init__(self, ids: list[int], texts: list[str], p: Decontam):
        self.p = p
        raw = [(t or "").encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        h, _, _, bounds = T.words(np.frombuffer(b"".join(raw), np.uint8), offsets, space=BREAK)
        n = np.diff(bounds)
        keep = np.flatnonzero(n)
        self.ids = np.asarray(ids, np.int64)[keep]
        self.words = [h[bounds[i] : bounds[i + 1]] for i in keep]
        self.n, self.k = n[keep], p.edits(n[keep])
        self.pieces: dict[int, tuple[Lookup, np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        for item, (size, k) in enumerate(zip(self.n, self.k, strict=True)):
            q = int(min(p.longest_piece, size // (k + 1)))
            found.setdefault(q, []).append((np.full(k + 1, item), np.arange(k + 1) * size // (k + 1)))
        for q, rows in found.items():
            items, places = (np.concatenate(x) for x in zip(*rows, strict=True))
            flat = np.concatenate([self.words[i][o : o + q] for i, o in zip(items, places, strict=True)])
            _, keys = run_hashes(flat, np.arange(len(items) + 1) * q, q)
            self.pieces[q] = Lookup(keys, np.arange(len(items))), items, places
        self.buckets = None
        if len(self.ids):
            keys = np.empty((len(self.ids), p.walks * p.tables), U)
            for own, width in by_width(self.n, p):
                matrix = np.full((len(own), width), PAD, U)
                for row, i in zip(matrix, own, strict=True):
                    row[: self.n[i]] = self.words[i]
                keys[own] = bucket_keys(matrix, self.n[own], p)
            self.buckets = Lookup(keys.ravel(), np.repeat(np.arange(len(self.ids)), keys.shape[1]))

    def leaks(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, first word) of the best passage for every row and item."""
        if self.buckets is None or not len(h):
            return []
        row_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        starts, sizes = [], []
        for q, (lookup, items, places) in self.pieces.items():
            at, keys = run_hashes(h, bounds, q)
            hit, piece = lookup.find(keys)
            item, offset = items[piece], places[piece]
            # a short item is its own piece: its first place in a row is its best passage
            exact = np.flatnonzero(self.k[item] == 0)
            _, first = np.unique(np.stack([row_of[at[hit[exact]]], item[exact]]), axis=1, return_index=True)
            use = np.zeros(len(hit), bool)
            use[exact[first]] = True
            use |= self.k[item] > 0
            hit, item, offset = hit[use], item[use], offset[use]
            for beside in range(-self.p.slack, self.p.slack + 1):
                ok = np.abs(beside) <= self.k[item]
                starts.append(np.stack([row_of[at[hit[ok]]], at[hit[ok]] - offset[ok] + beside]))
                sizes.append(self.n[item[ok]])
        row, start = np.concatenate(starts, axis=1)
        size = np.concatenate(sizes)
        start = np.maximum(start, bounds[row])
        windows = np.unique(np.stack([row, start, size]), axis=1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for own, width in by_width(windows[2], self.p):
            self._compare(h, bounds, windows[:, own], width, best)
        return [(r, i, d, s) for (r, i), (d, s) in best.items()]

    def _compare(self, h, bounds, windows, width, best) -> None:
        row, start, size = windows
        at = start[:, None] + np.arange(width)[None, :]
        inside = (np.arange(width)[None, :] < size[:, None]) & (at < bounds[row + 1][:, None])
        cut = np.where(inside, h[np.minimum(at, len(h) - 1)], PAD)
        keys = bucket_keys(cut, size, self.p)
        window, item = self.buckets.find(keys.ravel())
        pairs = np.unique(np.stack([window // keys.shape[1], item]), axis=1)
        done = set()
        for w, i in pairs.T:
            r, s, k = int(row[w]), int(start[w]), int(self.k[i])
            lo, hi = max(int(bounds[r]), s - k - self.p.slack), min(int(bounds[r + 1]), s + int(self.n[i]) + k + self.p.slack)
            if best.get((r, i), (k + 1,))[0] == 0 or (r, i, lo, hi) in done:
                continue
            done.add((r, i, lo, hi))
            d, first = fit(self.words[i], h[lo:hi])
            if d <= k:
                best[r, i] = min(best.get((r, i), (d, lo + first - int(bounds[r]))), (d, lo + first - int(bounds[r])))


def fit(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Least edits that make ``item`` of a stretch of ``passage``, and where the stretch starts."""
    n, m = len(item), len(passage)
    if n <= m:
        exact = np.flatnonzero(passage[: m - n + 1] == item[0])
        for s in exact:
            if np.array_equal(passage[s : s + n], item):
                return 0, int(s)
    # cost * big + start, so that the minimum also carries where its stretch began (the latest on ties is last)
    big = 1 << 32
    column = np.arange(m + 1, dtype=np.int64)
    line = column.copy()
    for j in range(n):
        swap = line[:-1] + np.where(passage == item[j], 0, big)
        new = np.empty(m + 1, np.int64)
        new[0] = line[0] + big
        new[1:] = np.minimum(swap, line[1:] + big)
        # insertions run along the line: minimum of earlier cells plus one edit a step
        line = np.minimum.accumulate(new - column * big) + column * big
    least = int(line.min())
    return least // big, least % big


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: Decontam = Decontam()) -> DataFrame:
    """doc_id, item_id, distance, item_words and first_word of every leaked item of every document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // p.block_items), -(-size.chars // p.block_chars))
    out = None
    for b in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = mine.orderBy("item_id").collect()
        index = spark.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], p))
        found = docs.mapInArrow(_searcher(index), LEAK)
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(index):
    def run(batches):
        own = index.value
        for rows, data, offsets in T.pieces(batches, "text"):
            h, _, _, bounds = T.words(data, offsets, space=BREAK)
            found = own.leaks(h, bounds)
            if found:
                r, i, d, s = map(np.array, zip(*found, strict=True))
                ids = rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(r))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own.ids[i]), pa.array(d.astype(np.int32)), pa.array(own.n[i].astype(np.int32)), pa.array(s.astype(np.int64))],
                    names=["doc_id", "item_id", "distance", "item_words", "first_word"],
                )

    return run


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
