"""SentencePiece encoding and decoding with a unigram model.

Text is marked (a marker in front, every blank a marker) and segmented into the
pieces with the greatest sum of log scores: a Viterbi pass whose arcs come from
a double-array trie of the pieces' bytes. A character without a piece scores
``unknown_gap`` below the worst piece and is written as its UTF-8 bytes.

No piece holds a marker or line feed after another character, so the best
segmentation of a text is that of its runs, and runs repeat: each task keeps
those it has solved, up to ``cached_runs``.

The model file is a parameter. A model without unigram scores (merge ranks
instead) gets them by Zipf's law on its ranks. Nothing is trained.

A marker character in the text itself is written as bytes, so decoding returns
every text unchanged. Defined cases: null stays null with no tokens; an empty
text has no tokens; repeated rows are encoded one by one.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ENCODED = "ids array<int>, n_tokens long, n_bytes long, score double"


@dataclass(frozen=True)
class Settings:
    model: str = MODEL
    unknown_gap: float = 10.0
    cached_runs: int = 600_000


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


#: fixed values of the model format: kinds of pieces, kinds of models
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1


class DoubleArray:
    """A trie over bytes in two arrays: the child of state s by byte c is
    ``base[s] + c + 1`` if ``check`` there is s; byte -1 (offset 0) ends a key."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1 << 10
        base, check, used = [0] * size, [-1] * size, bytearray(size)
        used[0] = 1
        free = 1
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            children = []
            at = lo
            while at < hi:
                label = keys[at][depth] + 1 if len(keys[at]) > depth else 0
                to = at + 1
                while to < hi and label and keys[to][depth] + 1 == label:
                    to += 1
                children.append((label, at, to))
                at = to
            while used[free]:
                free += 1
                if free + 300 > len(used):
                    base += [0] * size
                    check += [-1] * size
                    used += bytearray(size)
            offset = max(0, free - children[0][0])
            while True:
                if offset + 600 > len(used):
                    base += [0] * size
                    check += [-1] * size
                    used += bytearray(size)
                if not any(used[offset + label] for label, _, _ in children) and offset:
                    break
                offset += 1
            base[state] = offset
            for label, a, b in children:
                used[offset + label] = 1
                check[offset + label] = state
                if label:
                    todo.append((offset + label, a, b, depth + 1))
                else:
                    base[offset] = -1 - values[a]
        self.base, self.check = np.array(base, np.int32), np.array(check, np.int32)


class Model:
    """Pieces, their log scores and trie, read from a model file."""

    def __init__(self, settings: Settings = Settings()):
        self.settings = settings
        with open(settings.model, "rb") as f:
            data = f.read()
        pieces, kind = [], UNIGRAM
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        scores = [s for _, s, _ in pieces]
        if kind != UNIGRAM:
            ranked = sorted(usable, key=lambda i: (-scores[i], i))
            total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
            for r, i in enumerate(ranked, 1):
                scores[i] = -math.log(r) - total
        self.scores = scores
        self.unknown = min(scores[i] for i in usable) - settings.unknown_gap
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        bad = [self.pieces[i] for i in usable if MARK in self.pieces[i].lstrip(MARK) or "\n" in self.pieces[i]]
        if len(self.bytes) < 256 or bad:
            raise ValueError("the model needs byte pieces, and markers only in front")
        trie = DoubleArray([self.pieces[i].encode() for i in usable], usable)
        # a state's child may be sought up to 256 places on
        self.base, self.check = np.append(trie.base, np.zeros(300, np.int32)), np.append(trie.check, np.full(300, -1, np.int32))
        self.score_array = np.array(scores)


RUN = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class Encoder:
    """A model made ready in one task."""

    def __init__(self, model: Model):
        self.model, self.base, self.check = model, model.base.tolist(), model.check.tolist()
        self._forget()

    def run(self, run: str) -> tuple[tuple[int, ...], int, float]:
        """ids, how many of them are bytes, and the log score of one run."""
        data = run.encode("utf-8", "surrogatepass")
        base, check, scores, unknown = self.base, self.check, self.model.scores, self.model.unknown
        n, top = len(data), len(check)
        best, came, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, whole = best[at], False
            state, to = 0, at
            while to < n:
                child = base[state] + data[to] + 1
                if child >= top or check[child] != state:
                    break
                state = child
                to += 1
                end = base[state]
                if check[end] == state and base[end] < 0:
                    i = -1 - base[end]
                    score = here + scores[i]
                    if score > best[to]:
                        best[to], came[to], piece[to] = score, at, i
                    whole = whole or to == at + width
            if not whole:
                to = at + width
                score = here + unknown
                if score > best[to]:
                    best[to], came[to], piece[to] = score, at, -1
            at += width
        out: list[int] = []
        n_bytes, to = 0, n
        while to:
            start = came[to]
            if piece[to] >= 0:
                out.append(piece[to])
            else:
                own = [self.model.bytes[b] for b in data[start:to]]
                out += reversed(own)
                n_bytes += len(own)
            to = start
        return tuple(reversed(out)), n_bytes, best[n]

    def encode(self, text: str) -> tuple[list[int], int, float]:
        """One text; see ``encode_all``."""
        ids, sizes, n_bytes, score = self.encode_all([text])
        return ids.tolist(), int(n_bytes[0]), float(score[0])

    def encode_all(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and per text its number of ids, of bytes among them, and log score."""
        if len(self.index) > self.model.settings.cached_runs:
            self._forget()
        runs, ends = [], []
        for text in texts:
            if text:
                own = RUN.findall(MARK + text.replace(" ", MARK)) if MARK not in text else self._literal(text)
                runs += own
            ends.append(len(runs))
        self._learn({r for r in runs if r not in self.index})
        at = np.fromiter(map(self.index.__getitem__, runs), np.int64, len(runs))
        counts = self.counts[at]
        first = np.cumsum(counts) - counts
        ids = self.flat[np.repeat(self.starts[at] - first, counts) + np.arange(counts.sum())]
        bounds = np.array([0, *ends])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        # scores are summed text by text: a running sum over all would lose digits
        scores = self.scores[at]
        score = np.array([scores[a:b].sum() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        return ids, total(counts), total(self.n_bytes[at]), score

    def _literal(self, text: str) -> list:
        """Runs of a text that holds markers of its own: those are bytes, not blanks."""
        out = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(None)
            out += RUN.findall(part.replace(" ", MARK) if k else MARK + part.replace(" ", MARK))
        return out

    def _forget(self) -> None:
        self.index: dict = {}
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n_bytes, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def _learn(self, runs: set) -> None:
        """Solve runs that are new and keep them."""
        if not runs:
            return
        keys = sorted(runs, key=lambda r: (-1 if r is None else len(r), r or ""))
        raw = [None if r is None else r.encode() for r in keys]
        done = [None] * len(keys)
        short = [i for i, r in enumerate(raw) if r is not None and len(r) <= 48]
        for lo in range(0, len(short), 1 << 14):
            part = short[lo : lo + (1 << 14)]
            for i, own in zip(part, self.solve([raw[i] for i in part]), strict=True):
                done[i] = own
        for i, r in enumerate(keys):
            if r is None:
                done[i] = (tuple(self.model.bytes[b] for b in MARK.encode()), 3, self.model.unknown)
            elif done[i] is None:
                done[i] = self.run(r)
        counts = np.array([len(d[0]) for d in done], np.int64)
        starts = len(self.flat) + np.cumsum(counts) - counts
        for i, r in enumerate(keys):
            self.index[r] = len(self.starts) + i
        self.flat = np.concatenate([self.flat, np.array([x for d in done for x in d[0]], np.int32)])
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        self.n_bytes = np.concatenate([self.n_bytes, np.array([d[1] for d in done], np.int64)])
        self.scores = np.concatenate([self.scores, np.array([d[2] for d in done])])

    def solve(self, runs: list[bytes]) -> list[tuple[tuple[int, ...], int, float]]:
        """``run`` for many short runs at once, a lane each."""
        n, length = len(runs), np.array([len(r) for r in runs])
        width = int(length.max())
        data = np.zeros((n, width), np.uint8)
        data[np.arange(width)[None, :] < length[:, None]] = np.frombuffer(b"".join(runs), np.uint8)
        size = np.where(data < 0x80, 1, np.where(data < 0xC0, 0, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))))
        base, check, scores = self.model.base, self.model.check, self.model.score_array
        best = np.full((n, width + 1), -np.inf)
        came, piece = np.zeros((n, width + 1), np.int16), np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0
        whole = np.zeros(n, bool)
        for at in range(width):
            lanes = np.flatnonzero((length > at) & (size[:, at] > 0))
            whole[lanes] = False
            live, state, here = lanes, np.zeros(len(lanes), np.int64), best[lanes, at]
            for to in range(at + 1, width + 1):
                child = base[state] + data[live, to - 1] + 1
                ok = (check[child] == state) & (length[live] >= to)
                live, state, here = live[ok], child[ok], here[ok]
                if not len(live):
                    break
                end = base[state]
                final = np.flatnonzero((check[end] == state) & (base[end] < 0))
                if not len(final):
                    continue
                own, i = live[final], -1 - base[end[final]]
                score = here[final] + scores[i]
                better = score > best[own, to]
                up = own[better]
                best[up, to], came[up, to], piece[up, to] = score[better], at, i[better]
                whole[own[size[own, at] == to - at]] = True
            rest = lanes[~whole[lanes]]
            if len(rest):
                to = at + size[rest, at]
                score = best[rest, at] + self.model.unknown
                better = score > best[rest, to]
                rest, to = rest[better], to[better]
                best[rest, to], came[rest, to], piece[rest, to] = score[better], at, -1
        out, all_came, all_piece = [], came.tolist(), piece.tolist()
        for k, to in enumerate(length.tolist()):
            ids, n_bytes, total = [], 0, float(best[k, to])
            own_came, own_piece = all_came[k], all_piece[k]
            while to:
                i, start = own_piece[to], own_came[to]
                if i >= 0:
                    ids.append(i)
                else:
                    own = [self.model.bytes[b] for b in runs[k][start:to]]
                    ids += reversed(own)
                    n_bytes += len(own)
                to = start
            ids.reverse()
            out.append((tuple(ids), n_bytes, total))
        return out


class Decoder:
    def __init__(self, model: Model):
        self.parts = [b"" if k in (CONTROL, UNKNOWN, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]

    def decode(self, ids) -> str:
        text = b"".join([self.parts[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, settings: Settings = Settings(), column: str = "text", check: bool = False) -> DataFrame:
    """``docs`` with ids, n_tokens, n_bytes (ids that are bytes) and score; with
    ``check`` also ids_crc (CRC-32 of the ids as little-endian 32-bit) and
    round_trip (decoding the ids gives the text)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model(settings))
    added = ENCODED + (", ids_crc long, round_trip boolean" if check else "")
    names = [x.strip().split(" ")[0] for x in added.split(", ")]
    if set(names) & set(docs.columns):
        docs = docs.drop(*names)
    from pyspark.sql.types import StructType

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(added).fields])

    def run(batches):
        encoder, decoder = Encoder(model.value), Decoder(model.value)
        for rows, _, _ in T.pieces(batches, column, 1 << 20):
            texts = rows.column(rows.schema.get_field_index(column)).to_pylist()
            ids, sizes, n_bytes, score = encoder.encode_all(texts)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            null = np.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            new = [lists, pa.array(sizes), pa.array(n_bytes), pa.array(score)]
            if check:
                each = [None if z else ids[a:b] for z, a, b in zip(null, offsets[:-1], offsets[1:], strict=True)]
                new.append(pa.array([None if i is None else zlib.crc32(i.astype("<i4").tobytes()) for i in each], pa.int64()))
                new.append(pa.array([None if i is None else decoder.decode(i.tolist()) == t for i, t in zip(each, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, settings: Settings = Settings(), column: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids."""
    from pyspark.sql.types import StringType, StructField, StructType

    spark = encoded.sparkSession
    model = spark.sparkContext.broadcast(Model(settings))
    schema = StructType([*encoded.schema.fields, StructField(into, StringType())])

    def run(batches):
        decoder = Decoder(model.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column)).to_pylist()
            texts = [decoder.decode(i) if i is not None else None for i in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", "n_tokens", "n_bytes", "score", "ids_crc", "round_trip")
