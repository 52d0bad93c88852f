import random
import re

from lumigrid.llm import neardup


def sets(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, percent):
    """component_id by doc_id, from all pairs."""
    own = [(i, sets(t)) for i, t in rows]
    parent = {i: i for i, _ in own}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(own):
        for j, b in own[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                a_root, b_root = find(i), find(j)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return {i: find(i) for i, _ in own}


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(40, 300))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 12)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 70))):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [None, "", "  \n ", "One", "one", "a b c", "A  b\tc", "a b c d e", "é É", "x " * 3000]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_against_all_pairs(spark):
    rows = corpus()
    for percent in (80, 85):
        out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearDup(percent=percent)).collect()
        want = brute(rows, percent)
        assert {r.doc_id: r.component_id for r in out} == want
        assert {r.doc_id: r.n_shingles for r in out} == {i: len(sets(t)) for i, t in rows}
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(none).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_one_id_with_two_texts(spark):
    rows = [(3, "a b c"), (3, "d e f"), (1, "a b c"), (2, "d e f")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {1}


def family(seed, n, share):
    """A text and n copies with ``share`` of its words changed at random."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(200)]
    return [" ".join(w if rnd.random() > share else word() for w in base) for _ in range(n)] + [" ".join(base)]


def test_crowded_buckets_are_split_without_loss(spark):
    """Buckets over the bound are split by further registers, then compared by blocks."""
    texts = family(3, 50, 0.02) + family(4, 50, 0.05) + [t for _, t in corpus(2) if t]
    rows = list(enumerate(texts))
    for bucket in (2, 12):
        out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearDup(bucket=bucket)).collect()
        assert {r.doc_id: r.component_id for r in out} == brute(rows, 85)


def test_pairs_grow_with_the_members_of_a_family(spark, monkeypatch):
    """Families of 1000 half-alike and 1000 near-alike texts: a pair or so each, not each with each."""
    counts = []
    real = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *a: counts.append(pairs.count()) or real(pairs, *a))
    rows = list(enumerate(family(5, 1000, 0.12) + family(6, 1000, 0.004)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.component_id == 1001 for r in out) > 980
    assert sum(counts) < 2 * len(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    names = "doc_id int, text string, node string, key string, comp string, hub string, sketch string, n_shingles string"
    rows = [(None, "a b", *"uvwxyz"), (None, "a b", *"uvwxyz"), (5, "a b c d e f", *"uvwxyz"), (5, None, *"uvwxyz"), (4, "A b c d e f", *"uvwxyz"), (5, "q r s", *"uvwxyz"), (9, "q r s", *"uvwxyz")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, names)).collect()
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in out)
    # a row without words is linked with nothing, whatever its id's other rows are
    assert got == [(-1, 1, -1, True), (-1, 1, -1, True), (4, 2, 4, True), (5, 0, 5, True), (5, 1, 4, False), (5, 2, 4, False), (9, 1, 4, False)]
