import math
import random
import re
import struct

import pytest
import xxhash

from lumigrid.llm import quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w = words(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, r in enumerate(runs):
        if runs.count(r) > 1:
            hit.update(range(i, i + 5))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def corpus():
    rnd = random.Random(6)
    pool = ["alpha", "béta", "gamma", "délta", "𝔘x", "e#", "f|", "<g>", "h"]
    rows = []
    for k in range(250):
        text = "".join(rnd.choice(pool) + rnd.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(rnd.randint(0, 60)))
        if k % 3 == 0:
            text = "\n".join(" ".join(f"w{rnd.randint(0, 900)}" for _ in range(12)) for _ in range(4))
        if k % 7 == 0:
            text = " ".join(f"w{rnd.randint(0, 900)}###" for _ in range(50))
        rows.append((k, text))
    return rows + [(900, None), (901, ""), (902, " \n\t "), (903, "a b c d e " * 3000), (904, "one\u00a0two\u2028three"), (5, rows[5][1])]


def test_base_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int, score string")
    trusted = spark.createDataFrame([(i,) for i in range(250) if i % 7], "doc_id long")
    out = {r.row: r for r in quality.judge(docs, trusted).collect()}
    for k, (_, text) in enumerate(rows):
        r = out[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text), text
        assert not (r.kept and r.base_failed)
    # what trusted documents never show is refused, what they do is kept
    judged = [out[k] for k in range(250) if not out[k].base_failed]
    assert all(not r.kept for r in judged if r.doc_id % 7 == 0)
    assert sum(r.kept for r in judged if r.doc_id % 7 and r.doc_id % 3 == 0) >= 60


def test_ratio_is_the_smoothed_one(spark):
    rules = quality.QualityRules(buckets=8)
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c")], "doc_id long, text string")
    rows = quality.feature_counts(docs, docs.where("doc_id = 1").select("doc_id"), rules)
    assert sum(r.raw for r in rows.collect()) == 2 + 1 + 2 + 3 + 2 + 3 and sum(r.target for r in rows.collect()) == 5
    raw, target = [1] * 8, [1] * 8
    for r in rows.collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    want = [math.log(t / sum(target)) - math.log(r / sum(raw)) for t, r in zip(target, raw, strict=True)]
    assert quality.log_ratios(rows, rules) == pytest.approx(want, abs=1e-8)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(docs, docs.select("doc_id")).count() == 0
    one = spark.createDataFrame([(1, "a " * 20), (None, None)], "doc_id long, text string")
    assert quality.judge(one, docs.select("doc_id")).count() == 2


def test_shuffled_join_of_trusted_ids(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(100)] * 2, "doc_id long")
    both = [sorted((r.bucket, r.raw, r.target) for r in quality.feature_counts(docs, trusted, quality.QualityRules(broadcast_rows=n)).collect()) for n in (0, 1000)]
    assert both[0] == both[1]


def chained(*values):
    """The 64-bit hash of several values: each one's hash is the seed of the next."""
    h = 42
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def features(text):
    w = words(text)
    one = [chained(x) for x in w]
    return one + [chained(a, b) for a, b in zip(one, one[1:])] + [chained("end", x[-3:]) for x in w]


def test_score_and_verdict_against_brute_force(spark):
    rows, rules = corpus(), quality.QualityRules(buckets=512)
    trusted = {i for i in range(250) if i % 7} | {5, 777}
    raw, target = [1] * rules.buckets, [1] * rules.buckets
    for i, text in rows:
        for f in features(text):
            raw[f % rules.buckets] += 1
            target[f % rules.buckets] += i in trusted
    ratio = [math.log(t / sum(target)) - math.log(r / sum(raw)) for t, r in zip(target, raw, strict=True)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    out = {r.row: r for r in quality.judge(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), rules).collect()}
    verdicts = set()
    for k, (_, text) in enumerate(rows):
        own = [ratio[f % rules.buckets] for f in features(text)]
        want = sum(own) / len(own) if own else 0.0
        assert out[k].score == pytest.approx(want, abs=1e-6)
        if abs(want - rules.min_score) > 1e-6:
            assert out[k].kept == (not base(text)[-1] and want >= rules.min_score)
            verdicts.add((out[k].base_failed, out[k].kept))
    assert verdicts == {(True, False), (False, True), (False, False)}


def test_nulls_and_clashing_columns(spark):
    names = "one string, doc_id int, text string, words string, two string, t int, trusted_id int, row string, lines string, f int, raw int"
    rows = [("a", None, None, "b", "c", 1, 2, "r", "l", 3, 4), ("a", 1, "a b " * 20, "b", "c", 1, 2, "r", "l", 3, 4), ("a", 1, None, "b", "c", 1, 2, "r", "l", 3, 4)]
    docs = spark.createDataFrame(rows, names)
    out = quality.judge(docs, spark.createDataFrame([(1,), (1,), (None,)], "doc_id long"))
    assert out.columns[:11] == docs.columns
    assert sorted(tuple(r)[:11] for r in out.where("n_words = 40").collect()) == [rows[1]] and out.count() == 3
