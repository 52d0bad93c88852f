"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct k-word shingles, as 64-bit hashes. Each of
m registers keeps the maximum over the set of ``floor(1 - log_b(x))`` with x
exponential at rate ``rate``, truncated to 0..q+1: an exponentially spaced
truncated minimum. Registers of a union are the element-wise maximum.

1. Equal sets (by 128-bit fingerprint and size) become one node.
2. Bands of registers are hashed; a bucket is the nodes that share a band. The
   band is the longest that misses a pair at the threshold in at most
   ``miss`` of all cases.
3. Hubs: a bucket's head is the node whose buckets are the most crowded, so the
   text that a family was copied from. Each node is verified against one head,
   that of its buckets with the largest crowd around it. A family becomes a
   component with as many pairs as it has members.
4. The rest: in buckets that still hold several components, similarities are
   estimated from two sketches jointly, by maximum likelihood, inside the task
   that holds the bucket. Only pairs across components whose estimate is near or
   over the threshold leave the task, each once, from the first band they share.
   Buckets of more than ``bucket`` nodes are first split by further registers,
   with as many repetitions as keep the recall; what stays too large is compared
   block by block, so memory is bounded and no pair is left out.
5. All pairs are verified on the full shingle sets. A hub's set is sent once per
   ``share`` partners, not once per pair.

Defined cases: null or wordless texts have an empty set and are linked with
nothing; 1 to k-1 words are one shingle; rows that share a doc_id are one
document with the union of their sets' links; a null doc_id stays alone; an
empty table gives no rows. Only doc_id and text are read, so other columns may
have any names.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import cut, cut_counting, drop_table

U = np.uint64


@dataclass(frozen=True)
class NearDup:
    #: linked if percent_of * intersection >= percent * union
    percent: int = 85
    shingle: int = 5
    registers: int = 480
    base: float = 1.2
    rate: float = 20.0
    limit: int = 120
    #: share of pairs at the threshold that may share no band
    miss: float = 1e-5
    #: pairs are verified if their estimate is at most this far below the threshold (4 standard errors)
    margin: float = 0.07
    #: nodes of a bucket that one task compares at once
    bucket: int = 1024
    #: partners that share one copy of a hub's set
    share: int = 256

    def equal(self, similarity: float) -> float:
        """Probability that a register agrees, for sets of one size."""
        u = (1 - similarity) / 2
        return 1 + 2 * math.log1p(-u * (self.base - 1) / self.base) / math.log(self.base)

    @property
    def band(self) -> int:
        agree = self.equal(self.percent / 100)
        fits = [w for w in range(1, 33) if self.registers // w < 64 and (1 - agree**w) ** (self.registers // w) <= self.miss]
        return max(fits, default=max(1, -(-self.registers // 63)))

    @property
    def bands(self) -> int:
        return self.registers // self.band

    @property
    def repeats(self) -> int:
        """Splits of a bucket by ``band`` further registers that lose at most a twentieth of its pairs at the threshold."""
        return math.ceil(math.log(0.05) / math.log1p(-(self.equal(self.percent / 100) ** self.band)))


class Sketcher:
    """Registers of sets. One hash of an element gives all its register values:
    register j gets the element's j-th exponential variable."""

    def __init__(self, p: NearDup):
        self.p = p
        steps = T.mix(np.arange(1, p.registers + 1, dtype=U) * U(0xD6E8FEB86659FD93))
        self.steps = steps | U(1)
        # register value of a 16-bit uniform's leading digits would be coarse, so
        # the value is found from the smallest hash by one logarithm per register
        self.log_base = math.log(p.base)

    def registers(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """values: the sets one after another, none empty. The value is monotone in
        the hash, so it is taken of each register's minimum only."""
        p = self.p
        top = (values >> U(32)).astype(np.uint32)
        low = values.astype(np.uint32) | np.uint32(1)
        h, rest = np.empty_like(top), np.empty_like(top)
        least = np.empty((p.registers, len(bounds) - 1), np.uint32)
        for j in range(p.registers):
            s = np.uint32(int(self.steps[j]) & 0xFFFFFFFF)
            t = np.uint32(int(self.steps[j]) >> 33)
            # in place: the buffers stay in the cache
            np.multiply(np.bitwise_xor(top, t, out=h), s, out=h)
            np.add(h, np.multiply(low, np.uint32((int(s) * 0x85EBCA6B | 1) & 0xFFFFFFFF), out=rest), out=h)
            np.bitwise_xor(h, np.right_shift(h, np.uint32(15), out=rest), out=h)
            np.multiply(h, np.uint32(0x2C1B3C6D), out=h)
            np.bitwise_xor(h, np.right_shift(h, np.uint32(13), out=rest), out=h)
            np.minimum.reduceat(h, bounds[:-1], out=least[j])
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / p.rate
        return np.ascontiguousarray(np.clip(np.floor(1 - np.log(x) / self.log_base), 0, p.limit + 1).astype(np.uint8).T)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, p: NearDup) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from registers and set sizes.

    With u and v the shares of the elements only in a, only in b, the signs of
    the register differences are multinomial:
    P(a > b) = -log_b(1 - u (b-1)/b), P(a < b) alike, the rest equal."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    grid = np.linspace(0, 1, 201)[None, :]
    # sizes are known, so one parameter is left: u - v J = alpha etc.
    na, nb = na[:, None].astype(float), nb[:, None].astype(float)
    most = np.minimum(na, nb) / np.maximum(na, nb)
    j = grid * most
    union = (na + nb) / (1 + j)
    u, v = (union - nb) / union, (union - na) / union
    step = (p.base - 1) / p.base
    lost = math.log(p.base)
    above_p = np.clip(-np.log1p(-np.clip(u, 0, 1) * step) / lost, 1e-9, 1)
    below_p = np.clip(-np.log1p(-np.clip(v, 0, 1) * step) / lost, 1e-9, 1)
    equal_p = np.clip(1 - above_p - below_p, 1e-9, 1)
    fit = above[:, None] * np.log(above_p) + below[:, None] * np.log(below_p) + equal[:, None] * np.log(equal_p)
    best = fit.argmax(1)
    return j[np.arange(len(j)), best]


def sets_of(data, offsets, p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, bounds = T.words(data, offsets)
    values, row = T.shingles(h, bounds, p.shingle)
    return T.distinct_sets(values, row, len(offsets) - 1)


SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, sketch binary"


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every set, zero for empty ones."""
    full = np.flatnonzero(np.diff(bounds))
    fp1, fp2 = np.zeros(len(bounds) - 1, U), np.zeros(len(bounds) - 1, U)
    if len(full):
        fp1[full] = np.add.reduceat(T.mix(values ^ U(0xA5A5A5A5)), bounds[full])
        fp2[full] = np.add.reduceat(T.mix(values * U(3) + U(7)), bounds[full])
    return fp1.view(np.int64), fp2.view(np.int64)


def sketches(docs: DataFrame, p: NearDup) -> DataFrame:
    def run(batches):
        maker = Sketcher(p)
        for rows, data, offsets in T.pieces(batches, "text", 1 << 19):
            values, bounds = sets_of(data, offsets, p)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            sketch = [None] * len(n)
            if len(full):
                for i, r in zip(full, maker.registers(values, np.append(bounds[full], len(values))), strict=True):
                    sketch[i] = r.tobytes()
            fp1, fp2 = fingerprints(values, bounds)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(fp1), pa.array(fp2), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "fp1", "fp2", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _register_hash(regs: np.ndarray, seed: int) -> np.ndarray:
    """One hash per row of a (rows, n) matrix of registers."""
    key = np.full(len(regs), T.mix(np.array([seed], U))[0], U)
    for j in range(regs.shape[1]):
        key = T.mix(key * U(0x100000001B3) + regs[:, j].astype(U) + U(1))
    return key


def _bands(nodes: DataFrame, p: NearDup) -> DataFrame:
    """(key, band, node) for every band of every node."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _matrix(batch.column(1), p.registers)
            key = np.stack([_register_hash(regs[:, b * p.band : (b + 1) * p.band], b) for b in range(p.bands)], axis=1)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), p.bands)
            band = np.tile(np.arange(p.bands, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(node)], names=["key", "band", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, band int, node long")


def _split(rows: DataFrame, p: NearDup) -> DataFrame:
    """Rows of crowded buckets, each in ``repeats`` smaller ones: nodes that agree in further registers stay together."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            regs, band = _matrix(col("sketch"), p.registers), col("band").to_numpy()
            key = col("key").to_numpy().view(U)
            for again in range(p.repeats):
                new = np.empty(len(band), U)
                for b in np.unique(band):
                    own = np.flatnonzero(band == b)
                    others = np.delete(np.arange(p.registers), slice(b * p.band, (b + 1) * p.band))
                    places = np.random.default_rng([int(b), again]).choice(others, p.band, replace=False)
                    new[own] = T.mix(key[own] ^ _register_hash(regs[own][:, places], p.bands + again))
                yield batch.set_column(batch.schema.get_field_index("key"), "key", pa.array(new.view(np.int64)))

    return rows.mapInArrow(run, rows.schema)


#: hubs whose numbers of shares are broadcast (12 bytes each); beyond this they are joined by shuffle
BROADCAST_HUBS = 500_000
MEMBER = ["key", "band", "node", "comp", "sketch", "n_shingles", "skip", "mine", "left", "right"]


def pairs_in(regs: np.ndarray, sizes: np.ndarray, comp: np.ndarray, p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket's members in different components whose joint estimate is near or over the threshold."""
    least = p.percent / 100 - p.margin
    # a pair at the estimate's bar agrees in this many registers, less four standard errors
    agree = p.equal(least)
    enough = math.floor(p.registers * agree - 4 * math.sqrt(p.registers * agree * (1 - agree)))
    left, right = [], []
    for i in range(len(regs) - 1):
        rest = np.arange(i + 1, len(regs))
        small, large = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        rest = rest[(comp[rest] != comp[i]) & (100 * small >= p.percent * large)]
        rest = rest[np.count_nonzero(regs[rest] == regs[i], axis=1) >= enough]
        if len(rest):
            left.append(np.full(len(rest), i))
            right.append(rest)
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    a, b = np.concatenate(left), np.concatenate(right)
    ok = np.concatenate([estimate(regs[a[s : s + 4096]], regs[b[s : s + 4096]], sizes[a[s : s + 4096]], sizes[b[s : s + 4096]], p) for s in range(0, len(a), 4096)]) >= least
    return a[ok], b[ok]


def _likely(members: DataFrame, p: NearDup) -> DataFrame:
    """(hub, other) of the pairs of every bucket that are likely over the threshold.

    A pair leaves from the first band it shares, ``skip`` bands (split buckets) apart;
    in a bucket that is compared by blocks, from the task of its two blocks."""

    def run(batches):
        for group in _groups(batches, 0):
            col = {n: group.column(group.schema.get_field_index(n)) for n in MEMBER}
            regs, node = _matrix(col["sketch"], p.registers), col["node"].to_numpy()
            a, b = pairs_in(regs, col["n_shingles"].to_numpy(), col["comp"].to_numpy(), p)
            if not len(a):
                continue
            mine, lo, hi = col["mine"].to_numpy(), col["left"].to_numpy(), col["right"].to_numpy()
            ok = (np.minimum(mine[a], mine[b]) == lo[0]) & (np.maximum(mine[a], mine[b]) == hi[0])
            band, skip = int(col["band"][0].as_py()), col["skip"].to_numpy()
            if not (skip[0] >> band) & 1:
                earlier = np.zeros(len(a), bool)
                for e in range(band):
                    at = slice(e * p.band, (e + 1) * p.band)
                    earlier |= (regs[a, at] == regs[b, at]).all(1) & ((skip[a] >> e) & 1 == 0)
                ok &= ~earlier
            a, b = a[ok], b[ok]
            degree = np.bincount(np.concatenate([a, b]), minlength=len(node))
            turn = degree[b] > degree[a]
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["hub", "other"])

    return members.select(MEMBER).repartition("key").sortWithinPartitions("key").mapInArrow(run, "hub long, other long")


def _groups(batches, column: int):
    """Runs of rows with equal values of a sorted column, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(column).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[last is None or value[0] != last], value[1:] != value[:-1]]))
        at = 0
        for s in starts:
            if s > at:
                held.append(batch.slice(at, s - at))
            if held:
                yield pa.concat_batches(held)
            held, at = [], int(s)
        held.append(batch.slice(at))
        last = value[-1]
    if held:
        yield pa.concat_batches(held)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, p: NearDup) -> DataFrame:
    """(a, b) of the pairs (hub, other) that reach the threshold on full shingle sets."""
    used = pairs.select(F.col("hub").alias("node")).distinct().union(pairs.select(F.col("other").alias("node")).distinct()).distinct()
    wanted = nodes.join(used, "node", "left_semi").select("node", "first")
    texts = docs.join(wanted.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def sets(batches):
        for _, data, offsets in T.pieces(batches, "text"):
            values, bounds = sets_of(data, offsets, p)
            fp1, fp2 = fingerprints(values, bounds)
            raw = values.tobytes()
            packed = [raw[8 * s : 8 * e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fp1), pa.array(fp2), pa.array(np.diff(bounds)), pa.array(packed, pa.binary())], names=["fp1", "fp2", "n_shingles", "items"])

    # a doc_id may have rows of several sets: only those of a wanted node stay
    known = texts.select("text").mapInArrow(sets, "fp1 long, fp2 long, n_shingles long, items binary").selectExpr(f"{NODE} AS node", "items")
    known = cut(known.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    parts, n_hubs = cut_counting(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / p.share).cast("int").alias("parts")), "parts")
    salt = F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("salt")
    # a hub's pairs would meet in one task if they were dealt by hub
    partners = pairs.join(F.broadcast(parts) if n_hubs <= BROADCAST_HUBS else parts, "hub").select("hub", salt, "other").join(known.withColumnRenamed("node", "other"), "other").select("hub", "salt", "other", "items")
    hubs = parts.join(known.withColumnRenamed("node", "hub"), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("other"), "items")

    def run(batches):
        hub, own = None, None
        for batch in batches:
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            a, b = [], []
            for h, other, x in zip(col("hub").to_pylist(), col("other").to_pylist(), col("items"), strict=True):
                x = np.frombuffer(x.as_buffer(), U)
                if other is None:
                    hub, own = h, x
                    continue
                if hub != h:
                    raise ValueError("a partner stands before its hub")
                at = np.searchsorted(own, x)
                at[at == len(own)] = 0
                shared = int((own[at] == x).sum())
                if 100 * shared >= p.percent * (len(x) + len(own) - shared):
                    a.append(h)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    both = hubs.unionByName(partners).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("other"))
    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of an edge."""
    links = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "comp", F.least("comp", "near").alias("new"))
        up = labels.select(F.col("node").alias("up_node"), F.col("comp").alias("up"))
        step = step.join(up, step.new == up.up_node, "left").select("node", "comp", F.least("new", F.coalesce("up", "new")).alias("new"))
        step, changed = cut_counting(step, "labels", F.col("new") != F.col("comp"))
        drop_table(labels)
        labels = step.select("node", F.col("new").alias("comp"))
        if not changed:
            drop_table(links)
            return labels


#: a node's number follows from its set alone
NODE = "xxhash64(fp1, fp2, n_shingles)"


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = cut(sketches(docs, p).selectExpr("doc_id", "n_shingles", f"if(n_shingles > 0, {NODE}, null) AS node", "sketch"), "sketches")
    full = own.where("node is not null and doc_id is not null")
    nodes = cut(full.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n_shingles"), F.min_by("sketch", "doc_id").alias("sketch")), "nodes")
    labels = _linked(docs, full, nodes, p)
    comp = nodes.select("node", "first").join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "first")
    least = comp.groupBy("comp").agg(F.min("first").alias("component"))
    comp = comp.join(least, "comp").select("node", "component")
    # copies of one text may be a third of all rows, so this join is left to skew splitting
    out = own.select("doc_id", "n_shingles", "node").join(comp, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _one_document(full: DataFrame) -> DataFrame:
    """(a, b) of the nodes of one doc_id, where it has several sets."""
    ends = full.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    return full.select("doc_id", "node").join(ends, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after further edges between nodes: only components are joined anew."""
    of = lambda n: labels.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between, n = cut_counting(between.where("a <> b").distinct(), "between")
    if not n:
        return labels
    whole = components(between).select(F.col("node").alias("old"), F.col("comp").alias("new"))
    old = labels.join(whole, labels.comp == whole.old, "left").select("node", F.coalesce("new", "comp").alias("comp"))
    alone = whole.join(labels, whole.old == labels.node, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("comp"))
    return cut(old.unionByName(alone), "merged")


def _linked(docs: DataFrame, full: DataFrame, nodes: DataFrame, p: NearDup) -> DataFrame:
    """(node, comp) of all nodes that have a verified link."""
    all_bands = _bands(nodes, p)
    crowds = all_bands.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    shared = cut(all_bands.join(crowds, "key"), "buckets")
    pulls = shared.groupBy("node").agg(F.sum("crowd").alias("pull"))
    heads = shared.join(pulls, "node").groupBy("key").agg(F.max(F.struct("pull", "node")).alias("head"))
    star = shared.select("key", "node").join(heads, "key").where("node <> head.node").groupBy("node").agg(F.max("head").alias("head"))
    star = cut(star.select(F.col("head.node").alias("hub"), F.col("node").alias("other")), "star")
    edges, n = cut_counting(_verified(star, docs, nodes, p).unionByName(_one_document(full)), "edges")
    labels = components(edges) if n else docs.sparkSession.createDataFrame([], "node long, comp long")
    pairs, n = cut_counting(_rest(shared, nodes, labels, p), "likely")
    if n:
        labels = _merged(labels, _verified(pairs, docs, nodes, p))
    drop_table(shared)
    drop_table(pairs)
    return labels


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with the bucket's crowd."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("crowd")).where("x <> y").select("key", "crowd")
    return rows.join(keys, "key")


def _rest(shared: DataFrame, nodes: DataFrame, labels: DataFrame, p: NearDup) -> DataFrame:
    """(hub, other): likely pairs across components that share a bucket."""
    small = f"crowd <= {p.bucket}"
    marked = shared.select("key", "band", "node").join(labels, "node", "left").select("key", "band", "node", F.coalesce("comp", "node").alias("comp"))
    rows, n_large = cut_counting(_open(marked), "open", F.col("crowd") > p.bucket)
    alone = {"skip": F.lit(0).cast("long"), "mine": F.lit(0), "left": F.lit(0), "right": F.lit(0)}
    sketch = nodes.select("node", "sketch", "n_shingles")
    whole = rows.where(small).join(sketch, "node").withColumns(alone)
    if not n_large:
        return _likely(whole, p)
    large = rows.where(f"not {small}").drop("crowd").join(sketch, "node")
    # which bands of a node are split: those do not count as the first band of a pair
    bit = F.expr("shiftleft(1L, band)")
    skips = large.groupBy("node").agg(F.bit_or(bit).alias("skip"))
    with_skip = lambda df: df.drop("skip").join(skips, "node", "left").withColumn("skip", F.coalesce("skip", F.lit(0).cast("long")))
    parts = cut(_open(_split(large.select("key", "band", "node", "comp", "sketch", "n_shingles"), p)), "split")
    parts = with_skip(parts.withColumns(alone))
    # block by block: a row meets every block of its bucket, its own included
    blocks = F.ceil(F.col("crowd") / p.bucket).cast("int")
    mine = parts.where(f"not {small}").withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    mine = mine.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"left": F.least("mine", "with"), "right": F.greatest("mine", "with")})
    mine = mine.withColumn("key", F.xxhash64("key", "left", "right"))
    rows = [with_skip(whole), parts.where(small), mine]
    return functools.reduce(DataFrame.unionByName, [_likely(r.select(MEMBER), p) for r in rows]).distinct()


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: all pairs by shared shingles and a transitive closure; for small tables
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x.a, x.b FROM x JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.to_id = l.a),
c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
