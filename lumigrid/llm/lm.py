"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

A word's class is a hash of its last three bytes, so words that inflect alike
share a class and unseen words have one too. The ``members - 1`` most frequent
words of a class are members of their own; its other words, those never seen
included, share the last one. A token's probability:

    P(class | history) * P(member | class, history)              of a member word
    P(class | history) * P(last | class, history) * P(word | last)     of another

The first two are softmaxes over hashed features of the history: the previous
word, the word before it (a skip) and, for classes, the two together.
P(word | last) starts from the smoothed frequency (c + 1) / (N + V + 1) among the
other words of the class, which leaves one share for unknown words. All factors
sum to one.

With ``slots`` the history tells those other words apart too, however many they
are. They are the leaves of a binary tree over their places by falling count, one
tree a class; each inner node is a maximum-entropy decision between its halves
that starts from their frequencies (exact: runs of equal counts give the sum over
any places) and has hashed features of the previous word and the skip. A known
word's frequency is multiplied by the odds its path gained. Words of the head take
their places from a table that every task has, all others from a join, in training
and in scoring alike. Without ``slots`` they differ by frequency alone.

Training starts from the words' frequencies (the weights of the bias features)
and is distributed: in each of ``rounds`` rounds, over documents of its own, every
task sums observed and expected counts of all features at the same weights, the
sums of all tasks are added, and each weight moves by ``rate`` times the log of
their ratio: scaled maximum-entropy gradients. Nothing depends on how rows are
dealt to tasks but the order of additions. In the first round no history has a weight,
so expected counts follow from how often each row occurred, without a softmax a token.

What grows with the corpus is the table of word counts, which covers all
training documents; the ``head`` most frequent words are sent to every task, the
rest are joined by shuffle. Feature rows follow the training tokens up to
``rows`` and ``member_rows``; those bounds keep the weights at 10 MB, so that
each task can hold them.

Defined cases: null text is empty (an end token only); rows are scored one by
one, repeated rows with equal results; a null doc_id trains; without training
tokens every word is unknown and the model is uniform; an empty table gives no
rows; columns but doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .store import cut

U = np.uint64
END = U(0x5DEECE66D5DEECE6)


@dataclass(frozen=True)
class Lm:
    classes: int = 64
    #: words of a class that have a weight of their own, and one for all others; as many as classes
    members: int = 64
    #: most rows of the class weights, and of the members' weights (hashed with the class)
    rows: int = 1 << 13
    member_rows: int = 1 << 15
    #: training tokens to a row, up to these bounds
    row_tokens: int = 256
    rounds: int = 2
    batch: int = 4096
    rate: float = 0.5
    #: added to observed and expected counts
    prior: float = 2.0
    head: int = 1 << 18
    #: most weights of the decisions among a class's other words, a power of two (they follow the tokens as rows do); 0: by frequency alone
    slots: int = 0
    block: int = 128
    #: tasks whose sums are added first, so that no task reads those of all
    lot: int = 64
    #: training tokens to a task, and to a partition of the sums: a task's sums take up to 20 MB, so small ones share a task
    task_tokens: int = 1 << 22

    def __post_init__(self):
        if self.members != self.classes:
            raise ValueError("both softmaxes have one width: members must equal classes")
        if self.slots & (self.slots - 1):
            raise ValueError("slots must be a power of two")

    def sized(self, tokens: int) -> Lm:
        """With rows for this many training tokens."""
        fit = lambda most: max(4 * self.classes, min(most, 1 << (max(1, tokens // self.row_tokens) - 1).bit_length()))
        rows = max(self.block, fit(self.rows))
        member_rows = max(self.block, fit(self.member_rows))
        return replace(self, rows=-(-rows // self.block) * self.block, member_rows=-(-member_rows // self.block) * self.block, slots=min(self.slots, max(256, 1 << (max(1, tokens // self.row_tokens) - 1).bit_length())))

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows + self.member_rows, self.classes


#: the bias, the previous word, the word before it (a skip) and, for classes only, both together
FEATURES, MEMBER_FEATURES = 4, 3


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending's hash of every token, an end after each row's words, and the rows' bounds."""
    h, start, end, bounds = T.words(data, offsets)
    low = T.LOWER[data]
    tail = np.zeros(len(h), U)
    for back in (1, 2, 3):
        at = end - back
        tail = tail * U(257) + np.where(at >= start, low[np.maximum(at, 0)].astype(U) + U(1), U(0))
    n = np.diff(bounds)
    out = np.full(len(h) + len(n), END, U)
    kind = np.zeros(len(out), U)
    words_at = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    out[words_at], kind[words_at] = h, T.mix(tail)
    return out, kind, bounds + np.arange(len(bounds))


def classes_of(kind: np.ndarray, p: Lm) -> np.ndarray:
    return (kind % U(p.classes)).astype(np.int64)


def history(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(tokens, FEATURES - 1) hashes of what stands before each token of a row: the
    previous word, the word before it, and both."""
    n = np.diff(bounds)
    place = np.arange(len(h)) - np.repeat(bounds[:-1], n)
    one = np.where(place >= 1, np.concatenate([h[:1] * U(0), h[:-1]]), U(1))
    two = np.where(place >= 2, np.concatenate([h[:2] * U(0), h[:-2]]), U(2))
    return np.stack([T.mix(one * U(3) + U(1)), T.mix(two * U(7) + U(3)), T.mix(one * U(5) + T.mix(two))], axis=1)


def history_at(h: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first two columns of ``history``, of some tokens."""
    place = at - bounds[np.searchsorted(bounds, at, side="right") - 1]
    one = np.where(place >= 1, h[at - 1], U(1))
    two = np.where(place >= 2, h[at - 2], U(2))
    return np.stack([T.mix(one * U(3) + U(1)), T.mix(two * U(7) + U(3))], axis=1)


def rows_of(features: np.ndarray, kind: np.ndarray, p: Lm) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of the class softmax, and of the member softmax given the class. The
    bias features' rows stand first: one for the classes, one of each class for its members."""
    upper, lower = (np.zeros((len(features), n), np.int64) for n in (FEATURES, MEMBER_FEATURES))
    upper[:, 1:] = 1 + (features % U(p.rows - 1)).astype(np.int64)
    mixed = features[:, : MEMBER_FEATURES - 1] * U(0x9E3779B97F4A7C15) + kind.astype(U)[:, None] * U(0xC2B2AE3D27D4EB4F)
    lower[:, 0] = p.rows + kind
    lower[:, 1:] = p.rows + p.classes + ((mixed >> U(20)) % U(p.member_rows - p.classes)).astype(np.int64)
    return upper, lower


def factors_of(weights: np.ndarray) -> np.ndarray | None:
    """Powers of the weights, made once: their products are the powers of sums without an exponential a token. None if
    a weight is so large that a product could pass below float32's range and come back: up to three of these don't."""
    return np.exp(weights) if weights.max() < 15 else None


def begun_of(factors: np.ndarray | None, p: Lm) -> np.ndarray | None:
    """The class softmax's rows times its bias row, which stands first of every token's."""
    return None if factors is None else factors[: p.rows] * factors[0]


def _powers(weights: np.ndarray, rows: np.ndarray, factors: np.ndarray | None, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the sums of the rows' weights, and their sums (a column). A row of small or large ones is scaled by its largest.
    ``begun``: products of the first column's row, the same one everywhere, and the second's."""
    join, of = (np.add, weights) if factors is None else (np.multiply, factors)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = np.take(of, rows[:, 0], axis=0) if begun is None else np.take(begun, rows[:, 1], axis=0)
        for k in range(1 if begun is None else 2, rows.shape[1]):
            join(out, np.take(of, rows[:, k], axis=0), out=out)
        if factors is None:
            np.exp(out, out=out)
        total = np.vecdot(out, np.ones(out.shape[1], out.dtype))[:, None]  # row by row, not one product: that depends on a row's place
    # weights start as logarithms of shares, so few rows, if any, leave these bounds
    far = np.flatnonzero(~((total > 1e-4) & (total < 1e30)))
    if len(far):
        z = weights[rows[far]].sum(1)
        out[far] = np.exp(z - z.max(1, keepdims=True))
        total[far] = out[far].sum(1, keepdims=True)
    return out, total


def softmax(weights: np.ndarray, rows: np.ndarray, factors: np.ndarray | None = None, begun: np.ndarray | None = None) -> np.ndarray:
    z, total = _powers(weights, rows, factors, begun)
    z *= 1 / total
    return z


def softmax_at(weights: np.ndarray, rows: np.ndarray, label: np.ndarray, factors: np.ndarray | None = None, begun: np.ndarray | None = None) -> np.ndarray:
    """Each token's entry of the softmax for its label."""
    z, total = _powers(weights, rows, factors, begun)
    return z[np.arange(len(z)), label] / total[:, 0]


def add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add ``values`` (tokens, width) to the rows of ``into`` that each column of ``rows`` (tokens, columns) names.

    What goes to one row is cut into 1, 2, 4, ... values by the bits of its number. All pieces of a length are
    summed by one call over whole rows, and each row has one of a length, so none is written twice at a time."""
    flat = rows.T.astype(np.min_scalar_type(len(into) - 1)).ravel()
    order = np.argsort(flat, kind="stable")  # 16 bits are sorted by counting
    token, flat = np.tile(np.arange(len(rows)), rows.shape[1])[order], flat[order]
    at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
    row, n, length = flat[at].astype(np.intp), np.diff(at, append=len(flat)), 1
    item = np.dtype((np.void, into.shape[1] * into.itemsize))
    items = into.view(item)[:, 0]  # a row is written as one
    while len(n):
        odd = (n & 1).astype(bool)
        to = row[odd]
        part = np.take(values, token[at[odd] + np.arange(length)[:, None]], axis=0)
        part = part.sum(0) if length > 1 else part[0]
        part += np.take(into, to, axis=0)
        items[to] = part.view(item)[:, 0]
        more = n > 1
        at, row, n, length = (at + odd * length)[more], row[more], n[more] >> 1, length * 2


def add_observed(observed: np.ndarray, rows: np.ndarray, label: np.ndarray) -> None:
    """Count each feature row with its token's label."""
    np.add.at(observed.reshape(-1), rows.T.ravel() * observed.shape[1] + np.tile(label, rows.shape[1]), np.float32(1))


def without_history(weights: np.ndarray, p: Lm) -> bool:
    """Whether only bias rows have weights, as at the start."""
    return not (weights[1 : p.rows].any() or weights[p.rows + p.classes :].any())


def expected_without_history(weights: np.ndarray, observed: np.ndarray, by_kind: np.ndarray, p: Lm) -> np.ndarray:
    """Expected counts where only bias rows have weights: all tokens have one class softmax, and those of a class one of its
    members, so it takes no more than how often each row occurred. ``by_kind``: that of the members' rows, by class."""
    upper, lower = (softmax(weights, rows[:, None]) for rows in (np.zeros(1, np.int64), p.rows + np.arange(p.classes)))
    return np.concatenate([observed[: p.rows].sum(1, keepdims=True) * upper, by_kind @ lower])


def add_counts(observed: np.ndarray, expected: np.ndarray, weights: np.ndarray, rows: np.ndarray, label: np.ndarray, factors: np.ndarray | None = None, begun: np.ndarray | None = None) -> None:
    """Add the counts of a batch: each feature row with its token's label, and with the label's probabilities.

    The first feature is added run by run, so tokens with the same one should stand together."""
    g = softmax(weights, rows, factors, begun)
    first = rows[:, 0]
    add_observed(observed, rows, label)
    cuts, ones = np.flatnonzero(np.diff(first, prepend=-1, append=-1)), np.ones(len(g), g.dtype)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        expected[first[lo]] += ones[: hi - lo] @ g[lo:hi]
    add_rows(expected, rows[:, 1:], g)


def training(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 7 is not 2; a null id trains."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))


#: bytes of text that a task works through at a time
PIECE = 1 << 19

COUNT = "h long, kind int, n long"


def word_counts(docs: DataFrame, p: Lm) -> DataFrame:
    """(h, kind, n) of every distinct token of the documents; kind is its class."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h)
            h, kind, n = h[order], kind[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], kind[first], np.add.reduceat(n, first)

        for _, data, offsets in T.pieces(batches, "text", PIECE):
            h, kind, _ = tokens(data, offsets)
            order = np.argsort(h)  # any of equal ones: a fraction of the time of np.unique's
            ordered = h[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            held.append((ordered[first], classes_of(kind[order[first]], p).astype(np.int32), np.diff(np.append(first, len(h)))))
            size += len(first)
            if size > 1 << 20:
                held = [flush()]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield _count_batch(*held[0])
                    held, size = [], 0
        if held:
            yield _count_batch(*flush())

    return docs.mapInArrow(run, COUNT).groupBy("h").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))


def _count_batch(h, kind, n):
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "kind", "n"])


class Members:
    """The words that have a member of their own, found by one probe without collisions."""

    def __init__(self, h: np.ndarray, kind: np.ndarray, member: np.ndarray, n: np.ndarray, p: Lm):
        self.kind = kind.astype(np.int64)
        self.keys, self.member, self.n = (np.append(x, x.dtype.type(last)) for x, last in ((h.astype(U), 0), (member.astype(np.int64), p.members - 1), (n.astype(np.int64), 0)))
        self.bits = max(12, 2 * (len(h).bit_length() - 1))
        for self.odd in T.mix(np.arange(1, 1000, dtype=U)) | U(1):
            slot = self.slot(h)
            if len(np.unique(slot)) == len(h):
                break
        else:
            raise ValueError("no table without collisions")
        self.table = np.full(1 << self.bits, len(h), np.int32)
        self.table[slot] = np.arange(len(h))

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * self.odd) >> U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Member and count; the last member and 0 of all other words."""
        at = self.table[self.slot(h)]
        at = np.where(self.keys[at] == h, at, len(self.keys) - 1)
        return self.member[at], self.n[at]


def placed(counts: DataFrame) -> DataFrame:
    """With ``place``: each word's place in its class, the most frequent first."""
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "h")).cast("long") - 1)


def chosen_members(counts: DataFrame, p: Lm) -> Members:
    """The most frequent words of every class: at most classes x (members - 1) rows are gathered."""
    top = counts.where(F.col("place") < p.members - 1).select("h", "kind", F.col("place").alias("member"), "n").orderBy("h").toArrow()
    col = lambda n: top.column(n).to_numpy()
    return Members(col("h").astype(np.int64).view(U), col("kind"), col("member"), col("n"), p)


#: words whose paths are found at a time
WORDS = 1 << 14


class Rest:
    """The words without a member of their own, as leaves of one binary tree a class.

    ``runs``: kind, n and how many of the class's other words occur n times, by kind and falling n.
    Words stand one class after the other by falling n, so the sum of (n + 1) up to any of them is
    linear within a run; a class has no more runs than the root of twice its tokens."""

    def __init__(self, kind: np.ndarray, n: np.ndarray, words: np.ndarray, p: Lm):
        self.size = np.zeros(p.classes, np.int64)
        np.add.at(self.size, kind, words)
        self.base = np.cumsum(self.size) - self.size
        self.edge, self.mass = (np.concatenate([[0], np.cumsum(x)]).astype(np.float64) for x in (words, words * (n + 1)))

    def share(self, kind: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Each word's part of (n + 1) over its tree."""
        at, upto = self.base[kind], lambda x: np.interp(x, self.edge, self.mass)
        return (upto(at + place + 1) - upto(at + place)) / np.maximum(upto(at + self.size[kind]) - upto(at), 1.0)

    def paths(self, kind: np.ndarray, place: np.ndarray) -> Paths:
        """The decisions on the way to each word (its place counted from the first without a member). Some words at a
        time, since what finds them takes several times their room."""
        columns = list(zip(*(self._paths(kind[lo : lo + WORDS], place[lo : lo + WORDS]) for lo in range(0, max(1, len(kind)), WORDS)), strict=True))
        node, start, right, n, share = (np.concatenate(columns.pop(0)) for _ in range(5))
        return Paths(node, start, right, np.append(0, np.cumsum(n)), share)

    def _paths(self, kind: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Columns of ``Paths``, with how many decisions each word has. A node is cut where the sum of (n + 1) is next to its half."""
        word = np.argsort(self.base[kind] + place, kind="stable")  # interp is quicker in order
        lo, steps = self.base[kind[word]], []
        goal, hi = lo + place[word], lo + self.size[kind[word]]
        upto = lambda x: np.interp(x, self.edge, self.mass)
        below, above = upto(lo), upto(hi)
        while True:
            more = np.flatnonzero(hi - lo > 1)
            if not len(more):
                break
            word, goal, lo, hi, below, above = (x[more] for x in (word, goal, lo, hi, below, above))
            # no count gives a fraction of 1 - 0.4142..., so that rounding decides nothing
            middle = np.floor(np.interp((below + above) / 2, self.mass, self.edge) + (2**0.5 - 1)).astype(np.int64)
            middle = np.clip(middle, lo + 1, hi - 1)
            at, right = upto(middle), goal >= middle
            # a node is named by the word its right half begins with: no other node's does
            steps.append((word, (T.mix(middle.astype(U) + U(1)) >> U(32)).astype(np.uint32), np.log((above - at) / (at - below)).astype(np.float32), right))
            lo, below, hi, above = np.where(right, middle, lo), np.where(right, at, below), np.where(right, hi, middle), np.where(right, above, at)
        n = np.zeros(len(kind), np.int64)
        for own, *_ in steps:
            n[own] += 1
        bounds = np.append(0, np.cumsum(n))
        node, start, right = (np.zeros(bounds[-1], t) for t in (np.uint32, np.float32, bool))
        for k, (own, *step) in enumerate(steps):
            at = bounds[own] + k
            node[at], start[at], right[at] = step
        return node, start, right, n, self.share(kind, place)

    def paths_of(self, kind: np.ndarray, place: np.ndarray, p: Lm) -> tuple[Paths, np.ndarray]:
        """Paths of the distinct words among tokens given by class and place in it, and each token's word."""
        place = place - (p.members - 1)
        _, first, word = np.unique(self.base[kind] + place, return_index=True, return_inverse=True)
        return self.paths(kind[first], place[first]), word


@dataclass
class Paths:
    """Of each decision its node, log odds of the right half by frequency, and which half it is; each
    word's bounds in them, and its part of (n + 1) over its tree."""

    node: np.ndarray
    start: np.ndarray
    right: np.ndarray
    bounds: np.ndarray
    share: np.ndarray


def packed(features: np.ndarray) -> np.ndarray:
    """The features of a token's decisions in one number: 32 bits of the previous word's hash, and of the skip's."""
    return (features[:, 0] & U(0xFFFFFFFF00000000)) | (features[:, 1] >> U(32))


def slots_of(node: np.ndarray, feature: np.ndarray, p: Lm) -> np.ndarray:
    """Weights of a feature (32 bits) in a decision."""
    return (((feature ^ node) * np.uint32(0x9E3779B1)) >> np.uint32(32 - (p.slots.bit_length() - 1))).astype(np.int64)


def decisions(word: np.ndarray, before: np.ndarray, odds: np.ndarray, paths: Paths, p: Lm):
    """Of some tokens at a time: their slice, and for each decision its two slots, the log odds of the
    right half, which half it is, and the tokens' bounds in the decisions. ``word``: the tokens' places in ``paths``."""
    one, two = (before >> U(32)).astype(np.uint32), before.astype(np.uint32)
    for lo in range(0, len(word), p.batch):
        part = slice(lo, lo + p.batch)
        first = paths.bounds[word[part]]
        n = paths.bounds[word[part] + 1] - first
        ends = np.cumsum(n)
        at = np.repeat(first - (ends - n), n) + np.arange(ends[-1])
        node = paths.node[at]
        one_at, two_at = (slots_of(node, np.repeat(x[part], n), p) for x in (one, two))
        yield part, one_at, two_at, paths.start[at] + odds[one_at] + odds[two_at], paths.right[at], np.append(0, ends)


def gained(word: np.ndarray, before: np.ndarray, odds: np.ndarray, paths: Paths, p: Lm) -> np.ndarray:
    """log10 of what the history multiplies each token's frequency among its class's other words by."""
    out = -np.log(paths.share[word])
    for part, _, _, z, right, bounds in decisions(word, before, odds, paths, p):
        logs = np.append(0.0, np.cumsum(np.log(1 + np.exp(np.where(right, -z, z))), dtype=np.float64))
        out[part] -= np.diff(logs[bounds])
    return out / np.log(10)


def add_decisions(sums: np.ndarray, word: np.ndarray, before: np.ndarray, odds: np.ndarray, paths: Paths, p: Lm) -> None:
    """Add to ``sums`` (3, slots): decisions for the right half, those expected, and all decisions, by slot."""
    held: list[tuple] = []

    def flush():
        slot, seen, expected = (np.concatenate(x) for x in zip(*held, strict=True))
        for k, x in enumerate((seen, expected, None)):
            sums[k] += np.bincount(slot, x, p.slots)
        held.clear()

    for _, one, two, z, right, _ in decisions(word, before, odds, paths, p):
        expected = 1 / (1 + np.exp(-z))
        held += [(one, right, expected), (two, right, expected)]
        if len(held) >= 16:
            flush()
    if held:
        flush()


def moved_odds(odds: np.ndarray, sums: np.ndarray, p: Lm) -> np.ndarray:
    seen, expected, n = sums
    return odds + np.float32(p.rate) * (np.log((seen + p.prior) / (expected + p.prior)) - np.log((n - seen + p.prior) / (n - expected + p.prior))).astype(np.float32)


#: slots to a row of sums
SLOT_BLOCK = 1 << 13


def _slot_batch(sums: np.ndarray, lot: int) -> pa.RecordBatch:
    """Sums by slot as rows of ``SUMS``; their blocks are numbered downwards from -1."""
    used = [b for b in range(-(-sums.shape[1] // SLOT_BLOCK)) if sums[2, b * SLOT_BLOCK : (b + 1) * SLOT_BLOCK].any()]
    rows = [sums[:, b * SLOT_BLOCK : (b + 1) * SLOT_BLOCK].astype(np.float32).tobytes() for b in used]
    return pa.RecordBatch.from_arrays([pa.array([-1 - b for b in used], pa.int32()), pa.array(rows, pa.binary()), pa.array([lot] * len(used), pa.int32())], names=["block", "sums", "lot"])


TAIL = "h long, before long"


def _tail_tokens(docs: DataFrame, sent, p: Lm) -> DataFrame:
    """(h, before) of the tokens whose words are neither members nor in the head."""

    def run(batches):
        members, head = sent.value[1:3]
        for _, data, offsets in T.pieces(batches, "text", PIECE):
            h, _, bounds = tokens(data, offsets)
            at = np.flatnonzero(head.find(h)[0] == 0)
            at = at[members.find(h[at])[0] == p.members - 1]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (h[at], packed(history_at(h, bounds, at)))], names=["h", "before"])

    return docs.mapInArrow(run, TAIL)


def _tail_round(tail: DataFrame, sent, p: Lm) -> DataFrame:
    """Sums by slot of (kind, place, before) rows."""

    def run(batches):
        rest, odds = sent.value[3:]
        sums = np.zeros((3, p.slots))
        for batch in batches:
            paths, word = rest.paths_of(*(batch.column(k).to_numpy() for k in range(2)), p)
            add_decisions(sums, word, batch.column(2).to_numpy().view(U), odds, paths, p)
        yield _slot_batch(sums, TaskContext.get().partitionId() // p.lot)

    return tail.mapInArrow(run, SUMS)


def _round(docs: DataFrame, sent, p: Lm) -> DataFrame:
    """(block, lot, sums) of each task: observed and expected counts in blocks of weight rows; a lot is ``p.lot`` tasks.
    With slots, theirs of the head's words too."""

    def run(batches):
        weights, members, head, rest, odds = sent.value
        slot_sums, plain = np.zeros((3, p.slots)), without_history(weights, p)
        observed = np.zeros(p.shape, np.float32)
        if plain:
            by_kind = np.zeros((p.member_rows, p.classes), np.float32)
        else:
            factors = factors_of(weights)
            begun = begun_of(factors, p)
            expected, own = (np.zeros(p.shape, np.float32) for _ in range(2))
        for _, data, offsets in T.pieces(batches, "text", PIECE):
            h, ending, bounds = tokens(data, offsets)
            kind, (member, _) = classes_of(ending, p), members.find(h)
            before = history(h, bounds)
            if p.slots:
                n, word = head.find(h)
                at = np.flatnonzero((member == p.members - 1) & (n > 0))
                add_decisions(slot_sums, word[at], packed(before[at]), odds, head.paths(rest, p), p)
            order = np.argsort(kind.astype(np.int16), kind="stable")  # sums need no order, and equal bias features are next to each other
            kind, member = kind[order], member[order]
            upper, lower = rows_of(before[order], kind, p)
            if plain:
                for into, rows, label in ((observed, upper, kind), (observed, lower, member), (by_kind, lower - p.rows, kind)):
                    add_observed(into, rows, label)
                continue
            own[:] = 0  # a piece's sum first: small numbers added to a task's sum one by one would round alike
            for lo in range(0, len(h), ADDED * p.batch):
                part = slice(lo, lo + ADDED * p.batch)
                add_counts(observed, own, weights, upper[part], kind[part], factors, begun)
                add_counts(observed, own, weights, lower[part], member[part], factors)
            expected += own
        if plain:
            expected = expected_without_history(weights, observed, by_kind, p)
        blocks, lot = [x.reshape(-1, p.block * p.classes) for x in (observed, expected)], TaskContext.get().partitionId() // p.lot
        used = np.flatnonzero(blocks[0].any(1) | blocks[1].any(1))
        for lo in range(0, len(used), SENT):
            these = used[lo : lo + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(these.astype(np.int32)), pa.array([b"".join(x[b].tobytes() for x in blocks) for b in these], pa.binary()), pa.array(np.full(len(these), lot, np.int32))], names=["block", "sums", "lot"])
        if p.slots:
            yield _slot_batch(slot_sums, lot)

    return docs.mapInArrow(run, SUMS)


SUMS = "block int, sums binary, lot int"
#: batches whose counts are added at a time: in more tokens more rows are the same
ADDED = 2
#: blocks of sums that are sent at a time
SENT = 32


def _added(sums: DataFrame, partitions: int) -> DataFrame:
    """Sums by block, in two steps: within lots of tasks, then over lots. A task
    holds one sum for each of its keys, whatever the rows."""

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, c in zip(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True), batch.column(1), strict=True):
                own = np.frombuffer(c.as_buffer(), np.float32)
                if key in held:
                    held[key] += own
                else:
                    held[key] = own.astype(np.float32)
        keys = list(held)
        for lo in range(0, len(keys), SENT):
            blocks, lots = zip(*keys[lo : lo + SENT], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([held.pop(k).tobytes() for k in keys[lo : lo + SENT]], pa.binary()), pa.array(lots, pa.int32())], names=["block", "sums", "lot"])

    # what a task reads is one batch, in the JVM and in Python: it should stay small
    lots = sums.repartition(4 * partitions, "block", "lot").mapInArrow(run, SUMS)
    return lots.withColumn("lot", F.lit(0)).repartition("block").mapInArrow(run, SUMS)


def frequency_start(sizes: np.ndarray, p: Lm) -> np.ndarray:
    """Weights whose bias features give the (smoothed) frequencies of classes, and of members in a class; sizes: (classes, members)."""
    weights, n = np.zeros(p.shape, np.float32), sizes + 1.0
    weights[0] = np.log(n.sum(1) / n.sum())
    weights[p.rows : p.rows + p.classes] = np.log(n / n.sum(1, keepdims=True))
    return weights


def moved(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray, p: Lm) -> np.ndarray:
    return weights + np.float32(p.rate) * np.log((observed + p.prior) / (expected + p.prior)).astype(np.float32)


def train(docs: DataFrame, counts: DataFrame, members: Members, head: Head, rest: Rest, sizes: np.ndarray, p: Lm) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and those of the slots, after one pass over ``docs`` (training rows only), each round over documents of its own."""
    weights, odds, spark = frequency_start(sizes, p), np.zeros(p.slots, np.float32), docs.sparkSession
    partitions = int(max(1, sizes.sum() // p.task_tokens))
    for r in range(p.rounds):
        mine = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0))), F.lit(p.rounds)) == r)
        sent = spark.sparkContext.broadcast((weights, members, head, rest, odds))
        own = _round(mine.coalesce(partitions), sent, p)
        if p.slots:
            tail = _tail_tokens(mine.coalesce(partitions), sent, p).join(counts, "h").select("kind", "place", "before")
            own = own.unionByName(_tail_round(tail.coalesce(partitions), sent, p))
        rows = _added(own, partitions).collect()  # twice the size of the weights, and three times that of the slots
        sums, slot_sums = np.zeros((p.shape[0] // p.block, 2, p.block * p.classes), np.float32), np.zeros((3, p.slots))
        for row in rows:
            if row.block >= 0:
                sums[row.block] = np.frombuffer(row.sums, np.float32).reshape(2, -1)
            else:
                at = (-1 - row.block) * SLOT_BLOCK
                slot_sums[:, at : at + SLOT_BLOCK] = np.frombuffer(row.sums, np.float32).reshape(3, -1)
        weights, odds = moved(weights, sums[:, 0].reshape(p.shape), sums[:, 1].reshape(p.shape), p), moved_odds(odds, slot_sums, p)
        sent.destroy()
    return weights, odds


class Head:
    """Counts of the most frequent words, found by one probe, and the paths of those without a member of
    their own. Of words that share a slot the most frequent stays."""

    def __init__(self, h: np.ndarray, n: np.ndarray, kind: np.ndarray, place: np.ndarray):
        self.words = h, n, kind, place
        self.bits = max(10, int(len(h)).bit_length() + 2)
        self.at = np.zeros(1 << self.bits, np.int32)
        order = np.argsort(n, kind="stable")
        self.at[self.slot(h[order])] = order
        self.held = None

    def __reduce__(self):
        return Head, self.words  # without what is made of them

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, 0 where the word is not in the table, and which of its words it is."""
        own, n, *_ = self.words
        if not len(own):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int32)
        at = self.at[self.slot(h)]
        return np.where(own[at] == h, n[at], 0), at

    def paths(self, rest: Rest, p: Lm) -> Paths:
        """Of all words of the table, made once; a member's is that of the first word without one."""
        if self.held is None:
            _, _, kind, place = self.words
            self.held = rest.paths(kind, np.maximum(place - (p.members - 1), 0))
        return self.held


PART = "row_id long, doc_id long, held_out boolean, n_tokens long, n_head long, log_counts double, log_model double, tail array<long>, before array<long>"


def score_documents(docs: DataFrame, p: Lm = Lm(), row_filter=training) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    learn = docs.where(row_filter(F.col("doc_id")))
    counts = cut(placed(word_counts(learn, p)), "counts")
    by_class = {r.kind: (r.n, r.v) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total, distinct = sum(n for n, _ in by_class.values()), sum(v for _, v in by_class.values())
    p = p.sized(total)
    members = chosen_members(counts, p)
    top = counts.orderBy(F.desc("n"), "h").limit(p.head).select("h", "n", "kind", "place").toArrow()
    head = Head(top.column(0).to_numpy().astype(np.int64).view(U), *(top.column(k).to_numpy() for k in (1, 2, 3)))
    runs = counts.where(F.col("place") >= p.members - 1).groupBy("kind", "n").agg(F.count(F.lit(1)).alias("words")).orderBy("kind", F.desc("n")).toArrow()
    rest = Rest(*(runs.column(c).to_numpy().astype(np.int64) for c in ("kind", "n", "words")), p)
    # tokens of each member; the last one has what is left of its class
    sizes, kinds = np.zeros((p.classes, p.members)), np.zeros(p.classes)
    np.add.at(sizes, (members.kind, members.member[:-1]), members.n[:-1])
    np.add.at(kinds, members.kind, 1)
    for kind, (n, v) in by_class.items():
        sizes[kind, -1] += n - sizes[kind, :-1].sum()
        kinds[kind] = v - kinds[kind]
    weights, odds = train(learn, counts, members, head, rest, sizes, p)
    in_rest = -np.log10(sizes[:, -1] + kinds + 1)
    sent = spark.sparkContext.broadcast((weights, members, head, in_rest, rest, odds))
    marked = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", (~row_filter(F.col("doc_id"))).alias("held_out"), "text")
    parts = cut(marked.mapInArrow(_scorer(sent, p), PART), "scores")
    tail = parts.where(F.size("tail") > 0).select("row_id", F.explode(F.arrays_zip("tail", "before")).alias("t")).select("row_id", F.col("t.tail").alias("h"), F.col("t.before").alias("before"))
    known = tail.join(counts, "h")
    known = known.select("row_id", "n", "kind", "place", "before").mapInArrow(_tail_scorer(sent, p), TAIL_PART) if p.slots else known.withColumn("gain", F.lit(0.0))
    known = known.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_tail"), F.sum(F.log10(F.col("n") + 1.0)).alias("tail_logs"), F.sum("gain").alias("gain"))
    out = parts.drop("tail", "before").join(known, "row_id", "left")
    tail_logs = F.coalesce("tail_logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") + tail_logs - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        (F.col("log_model") + tail_logs + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def token_logs(h: np.ndarray, ending: np.ndarray, before: np.ndarray, weights: np.ndarray, members: Members, in_rest: np.ndarray, p: Lm, factors: np.ndarray | None = None, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of each token's model probability but for the count of a word without a
    member of its own; which tokens are such; and the others' counts."""
    kind, (member, n) = classes_of(ending, p), members.find(h)
    rest = member == p.members - 1
    upper, lower = rows_of(before, kind, p)
    each = np.where(rest, in_rest[kind], 0.0)
    for lo in range(0, len(h), p.batch):
        part = slice(lo, lo + p.batch)
        own = softmax_at(weights, upper[part], kind[part], factors, begun).astype(np.float64) * softmax_at(weights, lower[part], member[part], factors)
        each[part] += np.log10(np.maximum(own, 1e-300))
    return each, rest, n


def _scorer(sent, p: Lm):
    def run(batches):
        weights, members, head, in_rest, rest_words, odds = sent.value
        factors = factors_of(weights)
        begun = begun_of(factors, p)
        for rows, data, offsets in T.pieces(batches, "text", PIECE):
            h, ending, bounds = tokens(data, offsets)
            before = history(h, bounds)
            each, rest, n = token_logs(h, ending, before, weights, members, in_rest, p, factors, begun)
            in_head, word = head.find(h)
            count = np.where(rest, in_head, n)
            found = count > 0
            before = packed(before)
            if p.slots:
                told = np.flatnonzero(rest & found)
                each[told] += gained(word[told], before[told], odds, head.paths(rest_words, p), p)
            logs = np.log10(count + 1.0)
            at = bounds[:-1]
            add = lambda x: np.add.reduceat(x, at)
            n_rest = add((~found).astype(np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum(n_rest)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[~found].view(np.int64))) for x in (h, before)]
            col = lambda n: rows.column(rows.schema.get_field_index(n))
            model = add(each + np.where(rest, logs, 0.0))
            yield pa.RecordBatch.from_arrays(
                [col("row_id"), col("doc_id"), col("held_out"), pa.array(np.diff(bounds)), pa.array(add(found.astype(np.int64))), pa.array(add(logs)), pa.array(model), *lists],
                names=["row_id", "doc_id", "held_out", "n_tokens", "n_head", "log_counts", "log_model", "tail", "before"],
            )

    return run


TAIL_PART = "row_id long, n long, gain double"


def _tail_scorer(sent, p: Lm):
    """(row_id, n, gain) of (row_id, n, kind, place, before) rows."""

    def run(batches):
        rest, odds = sent.value[4:]
        for batch in batches:
            paths, word = rest.paths_of(*(batch.column(k).to_numpy() for k in (2, 3)), p)
            gain = gained(word, batch.column(4).to_numpy().view(U), odds, paths, p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gain)], names=["row_id", "n", "gain"])

    return run


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Lm(slots=1 << 17))
