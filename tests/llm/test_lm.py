import math
import random
import re
import struct
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lumigrid.llm import lm


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</end>"]


def corpus():
    rnd = random.Random(2)
    stems = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5))) for _ in range(80)]
    rows = []
    for k in range(900):
        end = ["ing", "ción", "keit"][k % 3]  # a document keeps to one
        rows.append((k, " ".join(rnd.choice(stems) + (end if rnd.random() < 0.7 else "") for _ in range(rnd.randint(0, 60)))))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "Éa " * 9000), (5, rows[5][1]), (None, "abc def")]


def test_base_scores(spark):
    rows = corpus()
    out = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), lm.Lm(head=100, batch=256, classes=16, members=16, row_tokens=8)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(
        (i if i is not None else -1, held(i), len(t := tokens(text)), sum(x in counts for x in t), total, round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in t), 6))
        for i, text in rows
    )
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want], abs=1e-5)
    # the model beats the base on documents that it has not seen
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


SMALL = lm.Lm(classes=8, members=8, rows=128, member_rows=256, block=128, head=40, row_tokens=1)


def brute(rows, p, held):
    """Score of each row: counts, classes, histories and softmaxes by plain loops over tokens."""
    def parsed(text):
        raw = (text or "").encode()
        h, ending, _ = lm.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return [int(x) for x in h], [int(x) % p.classes for x in ending]

    mix = lambda x: int(lm.T.mix(np.array([x % 2**64], np.uint64))[0])
    texts = [parsed(t) for _, t in rows]
    count, kind = Counter(), {}
    for (i, _), (h, k) in zip(rows, texts):
        kind |= dict(zip(h, k))
        if not held(i):
            count.update(h)
    p = p.sized(sum(count.values()))
    signed = lambda x: x - 2**64 if x >> 63 else x
    member, n = {}, np.zeros((p.classes, p.members))
    words_left = np.zeros(p.classes)
    for c in range(p.classes):
        own = sorted((w for w in count if kind[w] == c), key=lambda w: (-count[w], signed(w)))
        for m, w in enumerate(own):
            member[w] = min(m, p.members - 1)
            n[c, member[w]] += count[w]
            words_left[c] += member[w] == p.members - 1

    def features(h, at, c):
        one = h[at - 1] if at >= 1 else 1
        two = h[at - 2] if at >= 2 else 2
        own = [mix(one * 3 + 1), mix(two * 7 + 3), mix(one * 5 + mix(two))]
        lower = [((f * 0x9E3779B97F4A7C15 + c * 0xC2B2AE3D27D4EB4F) % 2**64 >> 20) % (p.member_rows - p.classes) for f in own[:2]]
        return [0] + [1 + f % (p.rows - 1) for f in own], [p.rows + c] + [p.rows + p.classes + x for x in lower]

    def softmax(w, at):
        z = w[at].sum(0)
        z = np.exp(z - z.max())
        return z / z.sum()

    weights = np.zeros(p.shape)
    weights[0] = np.log((n + 1).sum(1) / (n + 1).sum())
    weights[p.rows : p.rows + p.classes] = np.log((n + 1) / (n + 1).sum(1, keepdims=True))
    part = lambda i: int(xxhash.xxh64(struct.pack("<q", i or 0), seed=42).intdigest())
    for r in range(p.rounds):
        seen, expected = np.zeros(p.shape), np.zeros(p.shape)
        for (i, _), (h, _) in zip(rows, texts):
            if held(i) or signed(part(i)) % p.rounds != r:
                continue
            for at, w in enumerate(h):
                for own, label in zip(features(h, at, kind[w]), (kind[w], member[w])):
                    np.add.at(seen, (own, label), 1)  # two features of a token may share a row
                    np.add.at(expected, own, softmax(weights, own))
        weights = weights + p.rate * np.log((seen + p.prior) / (expected + p.prior))
    out = []
    for h, _ in texts:
        total = 0.0
        for at, w in enumerate(h):
            c, m = kind[w], member.get(w, p.members - 1)
            upper, lower = features(h, at, c)
            total += math.log10(softmax(weights, upper)[c] * softmax(weights, lower)[m])
            if m == p.members - 1:
                total += math.log10((count[w] + 1) / (n[c, -1] + words_left[c] + 1))
        out.append(total)
    return out


def test_scores_against_plain_loops(spark):
    rnd = random.Random(3)
    words = [f"{rnd.choice('abcdef')}{k}{rnd.choice(['ing', 'es', 'x'])}" for k in range(150)]
    rows = [(k, " ".join(rnd.choice(words[: 20 + 130 * (k % 2)]) for _ in range(rnd.randint(0, 25)))) for k in range(70)] + [(80, None), (None, "New Words here"), (4, words[0])]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    want = brute(rows, SMALL, held)
    for parts in (1, 5):
        docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(parts)
        out = lm.score_documents(docs, SMALL).collect()
        key = lambda r: (r[0] if r[0] is not None else -1, r[1])
        got = sorted(((r.doc_id, r.score) for r in out), key=key)
        mine = sorted(zip([i for i, _ in rows], want), key=key)
        assert [i for i, _ in got] == [i for i, _ in mine]
        assert [x for _, x in got] == pytest.approx([x for _, x in mine], rel=1e-4)


def test_probabilities_sum_to_one():
    """Over all classes, members, other words and one unknown of each class."""
    p, rnd = SMALL, np.random.default_rng(1)
    weights = rnd.normal(size=p.shape).astype(np.float32)
    before = np.array([[5, 6, 7]], np.uint64)
    total = 0.0
    for kind in range(p.classes):
        upper, lower = lm.rows_of(before, np.array([kind]), p)
        total += (lm.softmax(weights, upper)[0, kind] * lm.softmax(weights, lower)[0]).sum()
    assert total == pytest.approx(1, abs=1e-5)
    # within the last member: counts of its words and one share for what is unknown
    counts = np.array([3, 1, 1])
    assert ((counts + 1) / (counts.sum() + len(counts) + 1)).sum() + 1 / (counts.sum() + len(counts) + 1) == pytest.approx(1)


def test_rounds_raise_the_likelihood_and_bias_rows_give_frequencies():
    p = lm.Lm(classes=8, members=8, rows=128, member_rows=256, block=128)
    rnd = np.random.default_rng(0)
    sizes = rnd.integers(0, 50, (8, 8)).astype(float)
    weights = lm.frequency_start(sizes, p)
    assert lm.softmax(weights, np.zeros((1, 1), int))[0] == pytest.approx((sizes + 1).sum(1) / (sizes + 1).sum(), abs=1e-5)
    rows = np.concatenate([np.zeros((3000, 1), int), rnd.integers(1, 60, (3000, 3))], axis=1)
    label = rows[:, 1] % 8
    loss = lambda: -np.log(lm.softmax(weights, rows)[np.arange(3000), label]).mean()
    before = loss()
    for _ in range(6):
        seen, expected = np.zeros(p.shape, np.float32), np.zeros(p.shape, np.float32)
        for lo in range(0, 3000, 1000):
            lm.add_counts(seen, expected, weights, rows[lo : lo + 1000], label[lo : lo + 1000])
        assert seen.sum() == pytest.approx(12000) and expected.sum() == pytest.approx(12000, rel=1e-4)
        weights = lm.moved(weights, seen, expected, p)
        assert loss() < before
        before = loss()


def test_members_are_found_without_collisions():
    rnd = np.random.default_rng(4)
    h = np.unique(rnd.integers(1, 1 << 63, 4032).astype(np.uint64))
    m = lm.Members(h, np.zeros(len(h), int), np.arange(len(h)) % 63, np.arange(len(h)) + 1, lm.Lm())
    member, n = m.find(np.concatenate([h, h + np.uint64(1)]))
    assert (member[: len(h)] == np.arange(len(h)) % 63).all() and (n[: len(h)] == np.arange(len(h)) + 1).all()
    assert (member[len(h) :] == 63).all() and not n[len(h) :].any()


def test_rows_follow_the_tokens():
    p = lm.Lm()
    sizes = [p.sized(n).shape[0] for n in (0, 10**5, 10**6, 10**7, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[2] < sizes[3] and sizes[-1] == p.rows + p.member_rows
    with pytest.raises(ValueError):
        lm.Lm(members=8)


def test_clashing_columns(spark):
    rows = [(k, "a b c a b", 1, "x", 2) for k in range(9)]
    out = lm.score_documents(spark.createDataFrame(rows, "doc_id int, text string, n int, h string, row_id int"), SMALL).collect()
    assert len(out) == 9 and len({(r.score) for r in out}) == 1


def test_empty_table(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


DEEP = lm.replace(SMALL, slots=1 << 10)


def told_apart(rows, p, held):
    """What the history adds to each row's score for words without a member of their own: trees, decisions and
    rounds by plain loops over tokens and words."""
    u64 = lambda x: np.array([x % 2**64], np.uint64)
    mix = lambda x: int(lm.T.mix(u64(x))[0])
    signed = lambda x: x - 2**64 if x >> 63 else x
    texts, count, kind = [], Counter(), {}
    for i, text in rows:
        raw = (text or "").encode()
        h, ending, _ = lm.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        texts.append([int(x) for x in h])
        kind |= dict(zip(texts[-1], (int(x) % p.classes for x in ending)))
        if not held(i):
            count.update(texts[-1])
    p = p.sized(sum(count.values()))
    trees = [sorted((w for w in count if kind[w] == c), key=lambda w: (-count[w], signed(w)))[p.members - 1 :] for c in range(p.classes)]
    first = np.cumsum([0, *map(len, trees)])

    def path(w, h, at):
        """(slots, share of the right half, whether w is in it) of every decision."""
        tree = trees[kind[w]]
        lo, hi, place = 0, len(tree), tree.index(w)
        before = mix((h[at - 1] if at >= 1 else 1) * 3 + 1), mix((h[at - 2] if at >= 2 else 2) * 7 + 3)
        while hi - lo > 1:
            left, half = 0, sum(count[x] + 1 for x in tree[lo:hi]) / 2
            for middle in range(lo, hi):  # the half is in this word, or ends with it
                if left + count[tree[middle]] + 1 >= half:
                    break
                left += count[tree[middle]] + 1
            middle += (half - left) / (count[tree[middle]] + 1) >= 2 - 2**0.5
            middle = min(max(middle, lo + 1), hi - 1)
            right = sum(count[x] + 1 for x in tree[middle:hi])
            node = mix(int(first[kind[w]]) + middle + 1) >> 32
            yield [((f >> 32 ^ node) * 0x9E3779B1 % 2**32) >> (32 - (p.slots.bit_length() - 1)) for f in before], right / half / 2, place >= middle
            lo, hi = (middle, hi) if place >= middle else (lo, middle)

    odds = np.zeros(p.slots)
    after = lambda slots, share: 1 / (1 + (1 - share) / share * math.exp(-odds[slots].sum()))
    part = lambda i: signed(int(xxhash.xxh64(struct.pack("<q", i or 0), seed=42).intdigest()))
    other = lambda w: count[w] and w in trees[kind[w]]
    for r in range(p.rounds):
        seen, expected, n = np.zeros((3, p.slots))
        for (i, _), h in zip(rows, texts):
            for at, w in enumerate(h if not held(i) and part(i) % p.rounds == r else []):
                for slots, share, right in path(w, h, at) if other(w) else []:
                    for own in slots:
                        seen[own], expected[own], n[own] = seen[own] + right, expected[own] + after(slots, share), n[own] + 1
        odds = odds + p.rate * (np.log((seen + p.prior) / (expected + p.prior)) - np.log((n - seen + p.prior) / (n - expected + p.prior)))
    gain = lambda slots, share, right: math.log10(after(slots, share) / share if right else (1 - after(slots, share)) / (1 - share))
    return [sum(gain(*d) for at, w in enumerate(h) if other(w) for d in path(w, h, at)) for h in texts]


@pytest.mark.parametrize("head", [1, 40, 1000])
def test_words_without_a_member_against_plain_loops(spark, head):
    rnd = random.Random(3)
    words = [f"{rnd.choice('abcdef')}{k}{rnd.choice(['ing', 'es', 'x'])}" for k in range(150)]
    rows = [(k, " ".join(rnd.choice(words[: 20 + 130 * (k % 2)]) for _ in range(rnd.randint(0, 25)))) for k in range(70)] + [(80, None), (None, "New Words here"), (4, words[0])]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    more = told_apart(rows, DEEP, held)
    want = sorted(((i if i is not None else -1, a + b) for (i, _), a, b in zip(rows, brute(rows, SMALL, held), more)))
    assert max(map(abs, more)) > 0.1
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in lm.score_documents(docs, lm.replace(DEEP, head=head)).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-4)


def test_the_query_tells_rare_words_apart_by_their_history(spark, tmp_path):
    """Each rare word follows one word only. Both are of one class, whose 63 members are more frequent words: by
    frequency alone exchanging them costs nothing more."""
    often = " ".join(f"w{k:03d}zzz" for k in range(63))
    pairs = [(f"left{k}", f"rare{k}zzz") for k in range(2)]
    rows = [(k, " ".join([often] * 20 + [f"{a} {b}" for a, b in pairs] * 9)) for k in range(120)]
    held = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    rows += [(held[0], " ".join(f"{a} {b}" for a, b in pairs)), (held[1], " ".join(f"{a} {b}" for (a, _), (_, b) in zip(pairs, pairs[::-1])))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in lm.op2_lm_score(spark, str(tmp_path)).collect()}
    plain = {r.doc_id: r.score for r in lm.score_documents(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert score[held[0]] - score[held[1]] > plain[held[0]] - plain[held[1]] + 0.3


def test_probabilities_of_words_without_a_member_sum_to_one():
    rnd = np.random.default_rng(5)
    words = [1, 2, 3, 7, 64, 100, 0, 1]  # of each class
    kind = np.repeat(np.arange(8), words)
    n = np.concatenate([np.sort(rnd.integers(1, 9, k))[::-1] for k in words])
    place = np.concatenate([np.arange(k) for k in words])
    order = np.lexsort((-n, kind))
    rest = lm.Rest(kind[order], n[order], np.ones(len(n), int), SMALL)
    p, odds = DEEP, rnd.normal(size=DEEP.slots).astype(np.float32)
    paths = rest.paths(kind, place)
    share = np.array([(n[k] + 1) / (n[kind == kind[k]] + 1).sum() for k in range(len(n))])
    assert paths.share == pytest.approx(share)
    before = np.full(len(n), 0x123456789ABCDEF1, np.uint64)
    assert lm.gained(np.arange(len(n)), before, odds * 0, paths, p) == pytest.approx(np.zeros(len(n)), abs=1e-5)
    for batch in (4096, 16):
        after = share * 10 ** lm.gained(np.arange(len(n)), before, odds, paths, lm.replace(p, batch=batch))
        assert np.bincount(kind, after)[np.unique(kind)] == pytest.approx(1, abs=1e-5)
    assert abs(after - share)[kind == 5].max() > 1e-3


def test_slots_follow_the_tokens():
    p = lm.Lm(slots=1 << 17)
    assert [p.sized(n).slots for n in (0, 10**6, 10**9)] == [256, 4096, 1 << 17] and lm.Lm().sized(10**6).slots == 0
    with pytest.raises(ValueError):
        lm.Lm(slots=1000)


def test_slots_with_no_training_and_empty_tables(spark):
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    only = lm.score_documents(spark.createDataFrame([(held, "a b"), (held, None)], "doc_id long, text string"), DEEP).collect()
    assert len(only) == 2 and all(math.isfinite(r.score) and not r.train_tokens for r in only)
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), DEEP).count() == 0


class Docs:
    """Stands for documents: keeps the function that tasks run."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def groupBy(self, _):
        return self

    def agg(self, *_):
        return self


def test_memory_of_tasks(monkeypatch):
    """The check's executors have two tasks and 3,000 MB, of which the JVM takes more than 2,000. Here with all rows and
    slots, a full head, and rows of 4 KB."""
    p, rnd = lm.Lm(slots=1 << 17).sized(10**9), np.random.default_rng(6)
    text = " ".join(f"{x % 10**7:x}" for x in rnd.zipf(1.2, 900_000))[: 4 << 20]
    h, ending, _ = lm.tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    h, at, n = np.unique(h, return_index=True, return_counts=True)
    more = rnd.integers(1 << 40, 1 << 63, p.head - len(h)).astype(np.uint64)
    h, n, kind = np.append(h, more), np.append(n, np.ones(len(more), int)), np.append(lm.classes_of(ending[at], p), rnd.integers(0, p.classes, len(more)))
    order = np.lexsort((-n, kind))
    h, n, kind = h[order], n[order], kind[order]
    place = np.arange(len(h)) - np.searchsorted(kind, kind)
    own = place < p.members - 1
    members, rest = lm.Members(h[own], kind[own], place[own], n[own], p), lm.Rest(kind[~own], n[~own], np.ones((~own).sum(), int), p)
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda _: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array([text[lo : lo + 4096] for lo in range(0, len(text), 4096)])], names=["text"])

    class Sent:
        @property
        def value(self):  # read by each task
            return lm.frequency_start(np.ones((p.classes, p.members)), p), members, lm.Head(h, n, kind, place), rest, np.zeros(p.slots, np.float32)

    def peak(run):
        lm.T._powers.clear()
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        at = tracemalloc.get_traced_memory()[1] / 2**20
        tracemalloc.stop()
        return at

    train, count = Docs(), Docs()
    lm._round(train, Sent(), p)
    lm.word_counts(count, p)
    assert peak(train.run) < 150
    assert peak(count.run) < 80


def test_softmax_of_large_and_small_weights():
    w = np.random.default_rng(7).normal(size=(4, 8)).astype(np.float32)
    rows = np.array([[0], [1], [2], [3]])
    shifted = w + np.array([[0], [200], [-200], [-30]], np.float32)
    assert lm.softmax(shifted, rows) == pytest.approx(lm.softmax(w, rows), rel=1e-4)
    assert lm.softmax_at(shifted, rows, np.arange(4)) == pytest.approx(lm.softmax(w, rows)[np.arange(4), np.arange(4)], rel=1e-4)


def test_products_of_powers_are_the_softmax():
    rnd = np.random.default_rng(8)
    w = rnd.normal(size=(40, 8)).astype(np.float32) * 3
    rows = rnd.integers(0, 40, (500, 4))
    for shift in (0, -30, 9):  # -30: all sums are far below the range, and taken from the logarithms
        own = w + np.float32(shift) * (np.arange(40) < 20)[:, None].astype(np.float32)
        z = own[rows].astype(np.float64).sum(1)
        want = np.exp(z - z.max(1, keepdims=True))
        want /= want.sum(1, keepdims=True)
        factors = lm.factors_of(own)
        assert (factors is None) == (own.max() >= 15)
        assert lm.softmax(own, rows, factors) == pytest.approx(want, rel=1e-4, abs=1e-9)
        assert lm.softmax_at(own, rows, np.arange(500) % 8, factors) == pytest.approx(want[np.arange(500), np.arange(500) % 8], rel=1e-4, abs=1e-9)
    assert lm.factors_of(w + np.float32(20)) is None


@pytest.mark.parametrize("width", (8, 7))
def test_counts_need_no_call_a_row(width):
    """Rows that occur many times in a batch, odd widths too: sums as in plain loops, in a fixed number of numpy calls."""
    rnd = np.random.default_rng(9)
    rows = np.concatenate([np.zeros((4000, 1), int), 1 + rnd.integers(0, 300, (4000, 3))], axis=1)
    weights, label = rnd.normal(size=(301, width)).astype(np.float32), rnd.integers(0, width, 4000)
    seen, expected = (np.zeros(weights.shape, np.float32) for _ in range(2))
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "c_call" else None)
    try:
        lm.add_counts(seen, expected, weights, rows, label)
    finally:
        sys.setprofile(None)
    assert len(calls) < 200
    want_seen, want = np.zeros(weights.shape), np.zeros(weights.shape)
    for k in range(4):
        np.add.at(want_seen, (rows[:, k], label), 1)
        np.add.at(want, rows[:, k], lm.softmax(weights, rows).astype(np.float64))
    assert (seen == want_seen).all() and expected == pytest.approx(want, rel=1e-4)


def test_tokens_cost_no_exponentials(monkeypatch):
    """A round and the scoring take the powers of the weights once, however many tokens there are."""
    p = lm.replace(SMALL, classes=8)
    h, ending, _ = lm.tokens(np.frombuffer(b"ab cd ef " * 5000, np.uint8), np.array([0, 45000]))
    h, at, n = np.unique(h, return_index=True, return_counts=True)
    kind = lm.classes_of(ending[at], p)
    members, rest = lm.Members(h, kind, np.zeros(len(h), int), n, p), lm.Rest(*np.zeros((3, 0), np.int64), p)
    weights, made = lm.frequency_start(np.ones((p.classes, p.members)), p), []
    value = weights, members, lm.Head(h, n, kind, np.zeros(len(h), int)), rest, np.zeros(0, np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([False]), pa.array(["ab cd ef " * 5000])], names=["row_id", "doc_id", "held_out", "text"])
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda _: 0})())
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: made.append(np.size(x)) or exp(x, *a, **k))
    docs = Docs()
    lm._round(docs, type("Sent", (), {"value": value}), p)
    assert list(docs.run(iter([batch]))) and sum(made) <= weights.size
    made.clear()
    score = lm._scorer(type("Sent", (), {"value": (*value[:3], np.zeros(p.classes), *value[3:])}), p)
    assert list(score(iter([batch]))) and sum(made) <= weights.size


def one_task(monkeypatch, weights, p, text):
    """Sums of a training task at these weights, by block, and how many tokens' softmaxes it took."""
    made, powers = [], lm._powers
    monkeypatch.setattr(lm, "_powers", lambda w, rows, *a: made.append(len(rows)) or powers(w, rows, *a))
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda _: 0})())
    h, ending, _ = lm.tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    h, at, n = np.unique(h, return_index=True, return_counts=True)
    members = lm.Members(h, lm.classes_of(ending[at], p), np.arange(len(h)) % p.members, n, p)
    head, rest = lm.Head(h, n, members.kind, np.zeros(len(h), int)), lm.Rest(*np.zeros((3, 0), np.int64), p)
    docs = Docs()
    lm._round(docs, type("Sent", (), {"value": (weights, members, head, rest, np.zeros(0, np.float32))}), p)
    rows = [r for b in docs.run(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])) for r in b.to_pylist()]
    sums = np.zeros((p.shape[0] // p.block, 2, p.block * p.classes), np.float32)
    for r in rows:
        sums[r["block"]] = np.frombuffer(r["sums"], np.float32).reshape(2, -1)
    monkeypatch.setattr(lm, "_powers", powers)
    return sums, sum(made)


def test_the_first_round_makes_no_softmax_a_token(monkeypatch):
    """Only bias rows have weights then. The sums are those that a softmax for each token gives, which a weight of
    next to nothing brings back."""
    p, rnd = lm.replace(SMALL, batch=256), random.Random(10)
    text = " ".join(rnd.choice("abcdefgh") + rnd.choice("ijklmnop") * rnd.randint(1, 3) for _ in range(5000))
    weights = lm.frequency_start(np.random.default_rng(10).integers(0, 50, (p.classes, p.members)).astype(float), p)
    sums, made = one_task(monkeypatch, weights, p, text)
    assert made <= p.classes + 1
    weights[1, 0] = 1e-30
    want, made = one_task(monkeypatch, weights, p, text)
    assert made == 2 * 5001
    assert (sums[:, 0] == want[:, 0]).all() and sums[:, 1] == pytest.approx(want[:, 1], rel=1e-4, abs=1e-4)
    assert sums[:, 1].sum() == pytest.approx(7 * 5001, rel=1e-4)


@pytest.mark.parametrize("width", (8, 7))
def test_added_rows_are_sums(width):
    rnd = np.random.default_rng(11)
    for rows in (rnd.integers(0, 300, (4000, 3)), np.minimum(rnd.zipf(1.5, (3000, 2)), 69_999), np.full((1000, 2), 5), np.zeros((0, 3), int), np.array([[7]])):
        into, values = np.ones((70_000, width), np.float32), rnd.random((len(rows), width), np.float32)
        want = np.ones(into.shape)
        for k in range(rows.shape[1]):
            np.add.at(want, rows[:, k], values)
        lm.add_rows(into, rows, values)
        assert into == pytest.approx(want, rel=1e-5)


def test_products_with_the_bias_are_the_softmax():
    p, rnd = SMALL, np.random.default_rng(12)
    weights = rnd.normal(size=p.shape).astype(np.float32)
    upper, _ = lm.rows_of(rnd.integers(0, 1 << 63, (400, 3)).astype(np.uint64), np.zeros(400, int), p)
    factors = lm.factors_of(weights)
    want = lm.softmax(weights, upper)
    assert lm.softmax(weights, upper, factors, lm.begun_of(factors, p)) == pytest.approx(want, rel=1e-4)
    assert lm.begun_of(None, p) is None
    weights[0] -= 40  # sums below the bounds are taken from the logarithms
    factors = lm.factors_of(weights)
    assert lm.softmax(weights, upper, factors, lm.begun_of(factors, p)) == pytest.approx(want, rel=1e-4)


def test_memory_of_a_round_with_history(monkeypatch):
    """As ``test_memory_of_tasks``, whose weights are those of the first round, for a later one; without a head."""
    p, rnd = lm.Lm(slots=1 << 17).sized(10**9), np.random.default_rng(13)
    text = " ".join(f"{x % 10**7:x}" for x in rnd.zipf(1.2, 900_000))[: 4 << 20]
    weights = lm.frequency_start(np.ones((p.classes, p.members)), p) + rnd.normal(size=p.shape).astype(np.float32) / 4
    none = np.zeros(0, np.int64)
    value = weights, lm.Members(none.astype(np.uint64), none, none, none, p), lm.Head(none.astype(np.uint64), none, none, none), lm.Rest(none, none, none, p), np.zeros(p.slots, np.float32)
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda _: 0})())
    monkeypatch.setattr(lm, "add_decisions", lambda *_: None)
    docs, batch = Docs(), pa.RecordBatch.from_arrays([pa.array([text[lo : lo + 4096] for lo in range(0, len(text), 4096)])], names=["text"])
    lm._round(docs, type("Sent", (), {"value": value}), p)
    lm.T._powers.clear()
    tracemalloc.start()
    for _ in docs.run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert peak < 120
