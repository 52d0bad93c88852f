import random

import pytest
import xxhash

from lumigrid.llm import linededup as L


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j - 1] + (x != y), line[j] + 1, new[-1] + 1))
        line = new
    return line[-1]


def text_hash(t):
    h = 42 if t is None else xxhash.xxh64(t.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute(rows, p):
    """Text left by row, from all pairs of lines."""
    blanks = " \t\x0b\x0c\r\n"
    seen, out, gone = [], {}, set()
    order = [(d if d is not None else -(1 << 63), text_hash(t), k, i) for k, (d, t) in enumerate(rows) for i, _ in enumerate((t or "").split("\n"))]
    for _, _, k, i in sorted(order):
        body = rows[k][1].split("\n")[i].strip(blanks) if rows[k][1] else ""
        near = lambda b: p.max_edits and min(len(b), len(body)) >= p.min_chars and abs(len(b) - len(body)) <= 1 and edits(b, body) <= 1
        if body and any(b == body or near(b) for b in seen):
            gone.add((k, i))
        seen.append(body)
    for k, (d, t) in enumerate(rows):
        out[k] = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    line = lambda: "".join(rnd.choice("aabcé 中") for _ in range(rnd.randint(1, 30)))
    pool = [line() for _ in range(25)]

    def edit(x):
        at = rnd.randint(0, len(x))
        return rnd.choice([x[:at] + "b" + x[at:], x[:at] + x[at + 1 :], x[:at] + "ñ" + x[at + 1 :], x, x])

    rows = []
    for k in range(60):
        own = []
        for _ in range(rnd.randint(0, 7)):
            x = rnd.choice(pool)
            for _ in range(rnd.randint(0, 2)):
                x = edit(x)
            own.append(rnd.choice(["", " ", "\t"]) + x + rnd.choice(["", " "]))
        rows.append((k, "\n".join(own)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 9), (104, "x" * 9), (105, "long line " * 2000), (106, "long line " * 2000 + "!"), (None, "aaaaaaaaaaaa")]


def repeated_ids(seed):
    """Several null ids, ids with different texts and ids with equal ones."""
    rows = corpus(seed)
    return rows + [(None, "the very same line"), (None, "the very same line"), (None, "the very same lime\nand another"), (3, "the very same line"), (3, rows[3][1])] + [(7, rows[k][1]) for k in range(9, 14)]


def test_against_all_pairs(spark):
    for seed in (1, 2):
        for p in (L.LineDedup(), L.LineDedup(max_edits=0), L.LineDedup(min_chars=3)):
            rows = corpus(seed)
            want = brute(rows, p)
            docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, kept int").withColumnRenamed("kept", "row")
            out = L.dedup_lines(docs.repartition(3), p).collect()
            assert {r.row: r.text for r in out} == want
            assert all(r.n_removed == ((rows[r.row][1] or "").count("\n") - (r.text or "").count("\n") if r.text else r.n_removed) for r in out)


def test_rows_that_share_an_id_or_have_none(spark):
    rows = repeated_ids(4)
    want = brute(rows, L.LineDedup())
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, row int")
    out = L.dedup_lines(docs.repartition(3)).collect()
    # which of equal rows stays is open, so rows of one id and text are compared as a bag
    bag = lambda left: sorted((rows[k][0] or -1, rows[k][1] or "", t or "") for k, t in left)
    assert bag((r.row, r.text) for r in out) == bag(want.items())
    same = [r for r in out if r.doc_id is None and rows[r.row][1] == "the very same line"]
    assert sum(r.n_removed for r in same) >= 1 and len(same) == 2


def test_empty_and_clashes(spark):
    docs = spark.createDataFrame([(1, "same line here", 5), (2, "same line here", 6)], "doc_id long, text string, n_lines int")
    out = {r.doc_id: r for r in L.dedup_lines(docs).collect()}
    assert out[1].kept and not out[2].kept and out[2].text == "" and out[2].n_removed == 1
    assert L.dedup_lines(docs.limit(0)).count() == 0
    names = "tie string, doc_id long, c0 int, id string, text string, stay string, line string, h int"
    rows = [("t", 2, 8, "i", "same line here\nb", "s", "l", 1), ("t", None, 9, None, "same line here\na", "s", "l", 2)]
    docs = spark.createDataFrame(rows, names)
    out = {r.doc_id: r for r in L.dedup_lines(docs).collect()}
    assert tuple(out[2])[:8] == ("t", 2, 8, "i", "b", "s", "l", 1) and tuple(out[None])[:8] == rows[1]


def test_bounds_over_one_edit_are_refused():
    for bound in (2, -1):
        with pytest.raises(ValueError, match="max_edits"):
            L.LineDedup(max_edits=bound)
