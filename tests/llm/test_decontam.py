import random
import re

import numpy as np
import pytest

from lumigrid.llm import decontam


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fit(item, words):
    """Least edits between item and any stretch of words."""
    line = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(line[j - 1] + (x != y), line[j] + 1, new[-1] + 1))
        line = new
    return min(line)


def test_against_all_pairs(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [words(rnd.randint(5, 40)) for _ in range(40)]
    docs = []
    for k in range(160):
        text = words(rnd.randint(0, 300))
        for _ in range(k % 3):
            item = list(rnd.choice(items))
            for _ in range(rnd.randint(0, len(item) // 4)):
                at = rnd.randrange(len(item))
                how = rnd.random()
                if how < 0.5:
                    item[at] = rnd.choice(vocabulary)
                elif how < 0.75 and len(item) > 1:
                    del item[at]
                else:
                    item.insert(at, rnd.choice(vocabulary))
            place = rnd.randint(0, len(text))
            text[place:place] = item
        docs.append((k, rnd.choice([" ", ", ", "\n"]).join(text)))
    docs += [(900, None), (901, ""), (902, " ".join(items[0])), (902, " ".join(items[0]))]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(77, None), (78, " ".join(items[1][2:4])), (80, "two words"), (81, ""), (82, items[2][0]), (79, " ".join(items[0])), (None, "a b c d e f")]
    p = decontam.Decontam()
    out = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), p).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in out}
    want = {}
    for d, text in docs:
        for i, item in bench:
            t = tokens(item)
            if i is not None and t and (e := fit(t, tokens(text))) <= p.edits(len(t)):
                want[d, i] = e
    assert set(got) <= set(want)
    assert all(got[x] == want[x] for x in got)
    assert len(got) >= 0.97 * len(want) and len(want) > 60
    exact = {x for x, e in want.items() if e == 0}
    assert exact <= set(got)
    assert sum(r.doc_id == 902 and r.item_id == 79 for r in out) == 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, none).count() == 0
    assert decontam.find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_blocks_of_items_find_the_same(spark):
    docs = spark.createDataFrame([(1, "q a b c d e f g"), (2, "x y z u v w")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "x y z u v w")], "item_id long, text string")
    one, many = (sorted(map(tuple, decontam.find_leaks(docs, bench, decontam.Decontam(block_items=n)).collect())) for n in (10, 1))
    assert one == many and len(one) == 2


def edited(rnd, item, edits, vocabulary):
    out = list(item)
    for _ in range(edits):
        at, how = rnd.integers(len(out)), rnd.integers(3)
        if how == 0:
            out[at] = rnd.choice(vocabulary)
        elif how == 1:
            del out[at]
        else:
            out.insert(at, rnd.choice(vocabulary))
    return out


@pytest.mark.parametrize("n", [5, 10, 25, 60, 150])
def test_buckets_join_near_windows_and_part_others(n):
    """One window at the edit limit shares a bucket with its item in 95 % of cases or more; unrelated ones seldom do."""
    p, rnd = decontam.Decontam(), np.random.default_rng(n)
    vocabulary = decontam.T.mix(np.arange(1, 5001, dtype=np.uint64))
    m, width = 200, n
    items = rnd.choice(vocabulary, (m, n))
    near = np.full((m, width), decontam.PAD)
    for row, item in zip(near, items, strict=True):
        new = edited(rnd, item, int(p.edits(n)), vocabulary)[:n]
        row[: len(new)] = new
    size = np.full(m, n)
    a, b = (decontam.bucket_keys(x, size, p) for x in (items, near))
    assert (a == b).any(1).mean() >= 0.95
    others = np.roll(a, 1, axis=0)
    assert (others == b).any(1).mean() <= 0.06


def test_padding_is_hardly_sampled():
    p = decontam.Decontam()
    for n in (5, 40, 200):
        words = decontam.T.mix(np.arange(1, 300 * n + 1, dtype=np.uint64)).reshape(300, n)
        strings = decontam.embed(words, np.full(300, n), 0, p)
        assert (strings == decontam.PAD).mean() < 0.03


def test_long_items_and_texts(spark):
    """An item of 20,000 words among short ones, in a text of 60,000."""
    rnd = random.Random(1)
    long = [f"w{rnd.randrange(5000)}" for _ in range(20_000)]
    short = [f"s{k}" for k in range(12)]
    text = [f"x{rnd.randrange(9000)}" for _ in range(30_000)]
    near = [w if k % 400 else "changed" for k, w in enumerate(long)]
    docs = [(1, " ".join(text[:20_000] + near + text[20_000:])), (2, " ".join(text + short)), (3, " ".join(text)), (None, " ".join(short)), (None, " ".join(short))]
    bench = [(1, " ".join(long)), (2, " ".join(short))]
    out = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.distance, r.first_word) for r in out) == [(-1, 2, 0, 0), (-1, 2, 0, 0), (1, 1, 50, 20_000), (2, 2, 0, 30_000)]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "q a b c d e f g", "x", 5, None)], "doc_id long, text string, item_id string, distance int, n string")
    bench = spark.createDataFrame([(7, "a b c d e f", 9, "y")], "item_id int, text string, doc_id int, chars string")
    assert [tuple(r) for r in decontam.find_leaks(docs, bench).collect()] == [(1, 7, 0, 6, 1)]
