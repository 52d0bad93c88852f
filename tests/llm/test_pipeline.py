import random

import corpus_pipeline
from tests.llm import test_decontam, test_linededup, test_neardup
from lumigrid.llm import decontam, linededup


def corpus():
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(2000)]
    line = lambda n=0: " ".join(rnd.choice(vocabulary) for _ in range(n or rnd.randint(6, 30)))
    items = [line(25) for _ in range(6)]
    shared = line(60)
    rows, labels = [], []
    for k in range(160):
        text = [line() for _ in range(rnd.randint(2, 6))]
        if k % 9 == 0:
            text.insert(1, shared)
        if k % 13 == 0:
            text.insert(1, items[k % 6])
        if k % 11 == 0:
            text = [" ".join(w + "###" for w in x.split()) for x in text]
        rows.append((k, "\n".join(text), "en", "s", 0))
        labels.append((k, 0 if k % 11 == 0 else 1, 0))
    for k in range(20):
        words = rows[k * 3 + 1][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((200 + k, " ".join(words).replace("\n", " "), "en", "s", 0))
        rows.append((300 + k, " ".join(words).replace("\n", " ") + " x", "en", "s", 0))
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (3, rows[3][1], "en", "s", 0)]
    return rows, labels, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = (before, docs.collect())
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    assert all((i in kept) == (i % 11 != 0) for i in range(160))
    before, after = seen["lines"]
    left = test_linededup.brute(before, linededup.LineDedup())
    want = sorted((i, t) for (i, _), t in zip(before, left.values(), strict=True) if t is None or t.strip() or not dict(before)[i].strip())
    assert sorted((r.doc_id, r.text) for r in after) == want
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["copies"]
    comp = test_neardup.brute(before, corpus_pipeline.COPY_PERCENT)
    assert sorted(r.doc_id for r in after) == sorted(i for i, c in comp.items() if i == c) and len(comp) == len(before)
    before, after = seen["benchmark"]
    p = decontam.Decontam()
    leaks = {i for i, t in before if any(test_decontam.fit(test_decontam.tokens(x), test_decontam.tokens(t)) <= p.edits(len(test_decontam.tokens(x))) for x in items)}
    assert leaks and sorted(r.doc_id for r in after) == sorted(i for i, _ in before if i not in leaks)
    before, after = seen["tokens"]
    assert len(after) == len(before) and all(r.round_trip and len(r.ids) == r.n_tokens for r in after)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in after)


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Copies and leaks go, and one of each group stays, also where ids are missing or shared."""
    rnd = random.Random(2)
    text = lambda n=60: " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))
    item, a, b, c = text(25), text(), text(), text()
    leak = lambda: f"{text(20)} {item} {text(20)}"
    rows = [(None, a, "n1"), (None, a, "n2"), (1, a, "one"), (2, b, "two"), (2, b, "two"), (2, b, "three"), (2, c, "four"), (None, text(), "own"), (None, None, "null"), (None, None, "null")]
    rows += [(None, leak(), "leak"), (3, leak(), "leak"), (3, text(), "clean"), (4, leak(), "leak"), (5, "", "empty")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id int, text string, gone string").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    kept = sorted((r.doc_id or 0, r.gone) for r in out)
    assert [r.gone for r in out if r.text == a] == ["one"] and sum(r.text == b for r in out) == 1
    assert len(kept) == len(rows) - 4 and sum(r.text is None for r in out) == 2
    again = corpus_pipeline.near_dedup(spark, docs.repartition(5), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.gone) for r in again) == kept
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(r.gone for r in out) == sorted(g for _, _, g in rows if g != "leak")


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
