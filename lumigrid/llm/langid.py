"""Language identification with a bidirectional gated recurrent network over bytes.

Each byte's gate inputs are rows of a table; a forward and a backward GRU of
``hidden`` units read windows of ``window`` bytes of the text (A-Z lower-cased)
and a softmax over both states labels every position. A document's
probabilities are the mean over the positions of its letters, all of them. A
window starts from zero states, so windows are independent and a text of any
length is a batch of them.

The network is trained in numpy by backpropagation through time with Adam, in a
fixed number of steps on a bounded sample: about ``per_language`` windows of each
language, taken at hashed places of documents chosen by hash, several of a
document where a language has few. Every batch holds as many windows of each
language, so a rare one weighs as much as a common one. That bound is the only
one: every non-null language is learned and every byte of every document is read
in prediction. Language, source and id are never inputs.

Defined cases: a null text or one without a letter is ``und`` with score 0;
repeated rows are labelled one by one; without labelled rows all are ``und``;
more languages than ``most_languages`` are refused by name, not dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

U = np.uint64


@dataclass(frozen=True)
class LangId:
    hidden: int = 8
    window: int = 96
    per_language: int = 800
    most_languages: int = 10_000
    steps: int = 300
    batch: int = 128
    rate: float = 0.02
    lanes: int = 2048
    seed: int = 5


class Gru:
    """Parameters of one direction: e (256, 3h) inputs by byte, u (3h, h); gates z, r, candidate."""

    def __init__(self, h: int, rnd):
        self.h = h
        self.e = rnd.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
        self.u = rnd.normal(0, 0.7 / np.sqrt(h), (3 * h, h)).astype(np.float32)

    def parameters(self):
        return [self.e, self.u]

    def forward(self, x: np.ndarray, back: bool) -> tuple[np.ndarray, list]:
        """x: (steps, lanes) bytes. States (steps, h, lanes) and what backward needs."""
        steps, lanes = x.shape
        h = self.h
        table = np.ascontiguousarray(self.e.T)
        states, kept, s = np.empty((steps, h, lanes), np.float32), [], np.zeros((h, lanes), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            g = np.take(table, x[t], axis=1)
            g[: 2 * h] += self.u[: 2 * h] @ s
            zr = _sigmoid(g[: 2 * h])
            z, r = zr[:h], zr[h:]
            c = np.tanh(g[2 * h :] + self.u[2 * h :] @ (r * s))
            kept.append((t, s, z, r, c))
            s = s + z * (c - s)
            states[t] = s
        return states, kept

    def infer(self, x: np.ndarray, back: bool) -> np.ndarray:
        """States only, with few temporaries."""
        steps, lanes = x.shape
        h = self.h
        # sigmoid(v) = (1 + tanh(v / 2)) / 2, so halved gate inputs need one tanh for all
        table = np.ascontiguousarray(self.e.T)
        table[: 2 * h] *= 0.5
        uzr, uc = self.u[: 2 * h] * np.float32(0.5), self.u[2 * h :]
        states, s = np.empty((steps, h, lanes), np.float32), np.zeros((h, lanes), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            g = np.take(table, x[t], axis=1)
            zr = g[: 2 * h]
            zr += uzr @ s
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            c = g[2 * h :]
            c += uc @ (zr[h:] * s)
            np.tanh(c, out=c)
            c -= s
            c *= zr[:h]
            s = np.add(s, c, out=states[t])
        return states

    def backward(self, x: np.ndarray, kept: list, d_states: np.ndarray) -> list[np.ndarray]:
        h = self.h
        de, du = np.zeros_like(self.e), np.zeros_like(self.u)
        ds = np.zeros_like(d_states[0])
        for t, s, z, r, c in reversed(kept):
            ds = ds + d_states[t]
            dc = ds * z * (1 - c * c)
            dz = ds * (c - s) * z * (1 - z)
            drs = self.u[2 * h :].T @ dc
            dr = drs * s * r * (1 - r)
            g = np.concatenate([dz, dr, dc])
            du[: 2 * h] += g[: 2 * h] @ s.T
            du[2 * h :] += dc @ (r * s).T
            np.add.at(de, x[t], g.T)
            ds = ds * (1 - z) + drs * r + self.u[: 2 * h].T @ g[: 2 * h]
        return [de, du]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, labels: list[str], p: LangId):
        rnd = np.random.default_rng(p.seed)
        self.labels, self.p = labels, p
        self.ahead, self.back = Gru(p.hidden, rnd), Gru(p.hidden, rnd)
        self.w = rnd.normal(0, 0.3, (len(labels), 2 * p.hidden)).astype(np.float32)
        self.b = np.zeros((len(labels), 1), np.float32)

    def parameters(self):
        return [*self.ahead.parameters(), *self.back.parameters(), self.w, self.b]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, labels, lanes) for (steps, lanes) bytes."""
        h = self.p.hidden
        out = np.matmul(self.w[:, :h], self.ahead.infer(x, False))
        out += np.matmul(self.w[:, h:], self.back.infer(x, True))
        out += self.b
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions in ``use`` and its gradients, by
        backpropagation through time. y: label of each lane."""
        h = self.p.hidden
        a, kept_a = self.ahead.forward(x, False)
        b, kept_b = self.back.forward(x, True)
        both = np.concatenate([a, b], axis=1)
        z = np.matmul(self.w, both) + self.b
        z -= z.max(1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(1, keepdims=True)
        lanes, n = np.arange(x.shape[1]), max(1, int(use.sum()))
        loss = -(np.log(np.maximum(prob[:, y, lanes], 1e-30)) * use).sum() / n
        prob[:, y, lanes] -= 1
        d = prob * (use[:, None, :] / np.float32(n))
        dw = np.einsum("tkl,thl->kh", d, both)
        db = d.sum((0, 2))[:, None]
        d_both = np.matmul(self.w.T, d)
        return float(loss), [*self.ahead.backward(x, kept_a, d_both[:, :h]), *self.back.backward(x, kept_b, d_both[:, h:]), dw, db]

    def fit(self, windows: np.ndarray, y: np.ndarray) -> None:
        p, rnd = self.p, np.random.default_rng(self.p.seed)
        first, second = ([np.zeros_like(v) for v in self.parameters()] for _ in range(2))
        of = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        of = [own for own in of if len(own)]
        turn = 0
        for step in range(1, p.steps + 1):
            # the same share of each language; those that the last batch had no room for come first
            which = (turn + np.arange(p.batch)) % len(of)
            turn = (turn + p.batch) % len(of)
            own = np.array([of[k][i] for k, i in zip(which, rnd.integers(0, 1 << 31, p.batch) % np.array([len(of[k]) for k in which]), strict=True)])
            x = np.ascontiguousarray(windows[own].T)
            _, grads = self.gradients(x, y[own], LETTER[x])
            rate = p.rate * (1 - step / (p.steps + 1))
            for v, g, m, s in zip(self.parameters(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


#: bytes that count as letters' positions: ASCII letters and all bytes of other characters
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def learning(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 3 is not 1; a null id learns."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(True))


def sample(docs: DataFrame, p: LangId) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, windows and their labels' numbers, from learning rows with a language.

    Documents are taken by hash at a rate that gives each language about
    ``per_language`` windows; equal windows are gathered once."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learning(F.col("doc_id")))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(p.most_languages + 1).collect()}
    if len(sizes) > p.most_languages:
        raise ValueError(f"over {p.most_languages} values of lang; raise LangId.most_languages or clean the column")
    if not sizes:
        return [], np.zeros((0, p.window), np.uint8), np.zeros(0, np.int64)
    rates = [(lang, p.per_language / n, max(1, -(-p.per_language // n))) for lang, n in sizes.items()]
    rates = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate double, windows int"))
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    chosen = rows.join(rates, "lang").where(number < 1_000_003 * F.col("rate")).withColumn("k", F.explode(F.expr("sequence(1, windows)")))
    at = (F.pmod(F.xxhash64(F.lit(7), "doc_id", "k"), F.greatest(F.length("text") - p.window, F.lit(1))) + 1).cast("int")
    got = chosen.select("lang", F.substring("text", at, F.lit(p.window)).alias("piece")).distinct().orderBy("lang", "piece").collect()
    labels = sorted(sizes)
    windows = np.full((len(got), p.window), 32, np.uint8)
    for row, r in zip(windows, got, strict=True):
        raw = r.piece.encode()[: p.window]
        row[: len(raw)] = np.frombuffer(raw, np.uint8)
    number = {lang: i for i, lang in enumerate(labels)}
    return labels, T.LOWER[windows], np.array([number[r.lang] for r in got], np.int64)


def train(docs: DataFrame, p: LangId = LangId()) -> Network | None:
    labels, windows, y = sample(docs, p)
    if not labels:
        return None
    network = Network(labels, p)
    network.fit(windows, y)
    return network


def _documents(network: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean probabilities (rows, labels) over letters' positions, and each position's label (by row)."""
    p, n_rows = network.p, len(offsets) - 1
    sizes = np.diff(offsets)
    per_row = -(-sizes // p.window)
    row = np.repeat(np.arange(n_rows), per_row)
    within = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = offsets[row] + within * p.window
    length = np.minimum(p.window, offsets[row + 1] - start)
    sums, counts = np.zeros((n_rows, len(network.labels))), np.zeros(n_rows)
    marks = np.zeros(len(data), np.uint16)
    order = np.argsort(-length, kind="stable")  # equal lengths together: only the last windows of texts are short
    for lo in range(0, len(order), p.lanes):
        own = order[lo : lo + p.lanes]
        steps = int(length[own].max())
        at = start[own][None, :] + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < length[own][None, :]
        x = np.where(inside, T.LOWER[data[np.minimum(at, len(data) - 1)]], np.uint8(32))
        prob = network.probabilities(x)
        marks[at[inside]] = prob.argmax(1).astype(np.uint16)[inside]
        use = LETTER[x] & inside
        total = np.einsum("tkl,tl->lk", prob, use.astype(np.float32))
        np.add.at(sums, row[own], total)
        np.add.at(counts, row[own], use.sum(0))
    mean = sums / np.maximum(counts, 1)[:, None]
    return mean, marks


def predict(docs: DataFrame, network: Network | None, positions: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score (the mean probability of that
    language) and, with ``positions``, the label number of every byte of the text,
    two bytes each, the lower first."""
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("lang_pred string, score double, labels binary" if positions else "lang_pred string, score double").fields])
    sent = spark.sparkContext.broadcast(network)

    def run(batches):
        own = sent.value
        for rows, data, offsets in T.pieces(batches, "text", 2 << 20):
            col = lambda n: rows.column(rows.schema.get_field_index(n))
            lettered = col("lettered").to_numpy(zero_copy_only=False).astype(bool)
            if own is None:
                lang, score, marks = ["und"] * rows.num_rows, np.zeros(rows.num_rows), np.zeros(len(data), np.uint16)
            else:
                mean, marks = _documents(own, data, offsets)
                best = mean.argmax(1)
                score = np.where(lettered, mean[np.arange(len(best)), best], 0.0)
                lang = [own.labels[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            out = [col("doc_id"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))]
            if positions:
                raw = marks.astype("<u2").tobytes()
                out.append(pa.array([raw[2 * a : 2 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, train(docs))
    return out.select("doc_id", (~learning(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
