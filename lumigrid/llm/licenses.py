"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line, a template a short notice; both are sets of words. A block
matches when it contains at least ``threshold`` of a template's words. With
words ordered by how many texts of the whole corpus have them, rarest first,
a match of a template of m words (a = ceil(threshold * m) of them needed) must
share a word of the template's first m - a + 1 and of the block's first
|b| - a + 1 words (prefix filter), needs |b| >= a (length filter), and a shared
word at positions i and j leaves at most 1 + min(m - i, |b| - j) (positional
filter). What passes is verified on full sets. Words outside all templates
cannot add to an overlap, so blocks are reduced to template words first, and a
text whose own set falls short of every template has no block to look at.

Notices are also wrapped over lines. A template of L words is looked for in
every window of L words of a text, whatever the line breaks: the window matches
when its set does and ceil(threshold * L) of the template's words stand in it in
the template's order (longest common subsequence). The order keeps parts of two
neighbouring notices from making up a third.

Templates of one family differ by a word or two (GPL, LGPL, AGPL; the CC
licenses), fewer than the threshold lets go. A block or window must therefore
hold the words that tell its template from each such relative, and is the
relative's where it holds all that the relative has beyond the template.

Texts are read once: that pass counts words, finds phrases and writes the texts
that can match, under a number of their own, so rows need no unique doc_id.

Defined cases: null text is empty, without words and labels; repeated rows and
rows that share a doc_id, or have none, are each judged by their own text; an
empty table gives no rows; columns but doc_id and text are not read. Only A-Z
are lower-cased.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: fixed values: phrases that name a license by themselves
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
)

BREAK_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class LicenseScan:
    threshold: float = 0.9
    templates: tuple = TEMPLATES
    phrases: dict = field(default_factory=lambda: dict(PHRASES))

    def sets(self) -> list[tuple[int, str, list[str], int]]:
        """(id, label, words, needed overlap) of each template."""
        out = []
        for i, (label, text) in enumerate(self.templates):
            words = sorted(set(text.split()))
            out.append((i, label, words, math.ceil(self.threshold * len(words) - 1e-9)))
        return out

    def vocabulary(self) -> list[str]:
        return sorted({w for _, _, words, _ in self.sets() for w in words})

    def relatives(self) -> list[tuple[list[str], list[list[str]]]]:
        """For each template, the words it can't do without, and the sets of words of which it may hold none whole."""
        out = []
        for _, label, words, need in self.sets():
            own, must, without = set(words), set(), []
            for _, other, theirs, _ in self.sets():
                if other != label and len(own & set(theirs)) >= need:
                    must |= own - set(theirs)
                    if own <= set(theirs):
                        without.append(sorted(set(theirs) - own))
            out.append((sorted(must), without))
        return out


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _pieces(text: Column) -> Column:
    # lower() also lowers letters beyond A-Z; the Kelvin sign is the only one it makes an ASCII letter of
    return F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))), BREAK_RE)


def _told_apart(scan: LicenseScan, template: Column, tokens: Column) -> Column:
    """Whether the tokens are the template's own and not a relative's."""
    out = F.lit(True)
    for i, (must, without) in enumerate(scan.relatives()):
        ok = [F.array_contains(tokens, w) for w in must]
        ok += [~functools.reduce(lambda a, b: a & b, [F.array_contains(tokens, w) for w in words]) for words in without]
        if ok:
            out = out & ((template != i) | functools.reduce(lambda a, b: a & b, ok))
    return out


def _candidates(scan: LicenseScan, tokens: Column) -> Column:
    """Whether a set can contain a template at all."""
    enough = [F.size(F.array_intersect(tokens, _strings(words))) >= need for _, _, words, need in scan.sets()]
    least = min(a for *_, a in scan.sets())
    return (F.size(tokens) >= least) & functools.reduce(lambda a, b: a | b, enough)


def blocks(texts: DataFrame, scan: LicenseScan) -> DataFrame:
    """row, block and the block's distinct template words, for blocks long enough to match anything."""
    least = min(a for *_, a in scan.sets())
    lines = texts.select("row", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    sets = lines.select("row", "block", F.array_intersect(_pieces(F.col("line")), _strings(scan.vocabulary())).alias("tokens"))
    return sets.where(F.size("tokens") >= least)


def word_order(texts: DataFrame, scan: LicenseScan) -> dict[str, int]:
    """Rank of every template word by the number of texts that have it; as many rows as the templates have words."""
    counts = {r.token: r["count"] for r in texts.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()}
    return {w: i for i, w in enumerate(sorted(scan.vocabulary(), key=lambda w: (counts.get(w, 0), w)))}


def matches(texts: DataFrame, scan: LicenseScan, order: dict[str, int]) -> DataFrame:
    """row, label, containment of every block that reaches the threshold."""
    rows = []
    for i, label, words, need in scan.sets():
        ranks = sorted(order[w] for w in words)
        rows += [(i, label, len(ranks), need, words, rank, at) for at, rank in enumerate(ranks[: len(ranks) - need + 1])]
    # one row per template and prefix word: fixed by the parameter, not by the data
    index = F.broadcast(texts.sparkSession.createDataFrame(rows, "template int, label string, m int, need int, words array<string>, rank int, i int"))
    ranked = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    least = min(a for *_, a in scan.sets())
    own = blocks(texts, scan).withColumn("ranks", F.sort_array(F.transform("tokens", lambda w: ranked[w]))).withColumn("size", F.size("tokens"))
    probe = own.select("row", "block", "tokens", "size", F.posexplode(F.slice("ranks", F.lit(1), F.col("size") - least + 1)).alias("j", "rank"))
    near = probe.join(index, "rank").where("size >= need and j <= size - need and 1 + least(m - i - 1, size - j - 1) >= need")
    shared = F.size(F.array_intersect("tokens", "words"))
    found = near.withColumn("shared", shared).where("shared >= need").where(_told_apart(scan, F.col("template"), F.col("tokens")))
    return found.select("row", "label", (F.col("shared") / F.col("m")).alias("containment"))


def _in_order(window: Column, template: Column) -> Column:
    """Length of the longest common subsequence. The state holds, for each place
    of the template, the longest one that ends there."""
    start = F.transform(template, lambda _: F.lit(0))

    def step(state: Column, word: Column) -> Column:
        longer = lambda i: F.coalesce(F.array_max(F.slice(state, F.lit(1), i)), F.lit(0)) + 1
        return F.transform(template, lambda own, i: F.when(own == word, longer(i)).otherwise(F.get(state, i)))

    return F.aggregate(window, start, step, F.array_max)


def wrapped_matches(texts: DataFrame, scan: LicenseScan, order: dict[str, int]) -> DataFrame:
    """row, label, containment of templates found in windows of the texts' words."""
    rows = []
    for i, label, words, need in scan.sets():
        seq = scan.templates[i][1].split()
        prefix = sorted(words, key=order.get)[: len(words) - need + 1]
        fields = {"template": F.lit(i), "label": F.lit(label), "words": _strings(words), "seq": _strings(seq), "prefix": _strings(prefix)}
        fields |= {"need": F.lit(need), "ordered": F.lit(math.ceil(scan.threshold * len(seq) - 1e-9))}
        rows.append(F.struct(*[v.alias(k) for k, v in fields.items()]))
    enough = lambda t: F.arrays_overlap("tokens", t["prefix"]) & (F.size(F.array_intersect("tokens", t["words"])) >= t["need"])
    out = texts.select("row", F.array_remove(_pieces(F.col("text")), "").alias("all"), F.explode(F.filter(F.array(*rows), enough)).alias("t"))
    places = F.filter(F.transform("all", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains("t.words", x["word"]))
    out = out.select("row", "all", "t", places.alias("places"))
    inside = lambda x, k: F.filter(F.slice("places", k + 1, F.size("t.seq")), lambda y: y["at"] < x["at"] + F.size("t.seq"))
    # windows with as many template words as are needed, repeats counted
    full = lambda x, k: F.coalesce(F.get("places", k + F.col("t.need") - 1)["at"] < x["at"] + F.size("t.seq"), F.lit(False))
    window = lambda x, k: F.struct(F.transform(inside(x, k), lambda y: y["word"]).alias("own"), x["at"].alias("at"))
    windows = F.array_compact(F.transform("places", lambda x, k: F.when(full(x, k), window(x, k))))
    right = F.filter(windows, lambda w: F.size(F.array_distinct(w["own"])) >= F.col("t.need"))
    right = F.filter(right, lambda w: _in_order(w["own"], F.col("t.seq")) >= F.col("t.ordered"))
    # all words of the window, relatives' words among them
    whole = lambda w: F.array_intersect(F.slice("all", w["at"] + 1, F.size("t.seq")), _strings(scan.vocabulary()))
    right = F.filter(right, lambda w: _told_apart(scan, F.col("t.template"), whole(w)))
    # always true, but the optimizer moves no filter below it, which would compute the places anew for each window
    here = F.monotonically_increasing_id() >= 0
    out = out.select("row", "t", F.when(here, F.array_max(F.transform(right, lambda w: F.size(F.array_distinct(w["own"]))))).alias("shared")).where("shared is not null")
    return out.select("row", "t.label", (F.col("shared") / F.size("t.words")).alias("containment"))


def _starts_with(parts: list[str]):
    def at(i: Column) -> Column:
        same = [F.coalesce(F.get("words", i + d) == p, F.lit(False)) for d, p in enumerate(parts)]
        return functools.reduce(lambda a, b: a & b, same)

    return at


def phrase_places(docs: DataFrame, scan: LicenseScan = LicenseScan()) -> DataFrame:
    """Adds words, n_words, and per phrase the array of places (from 0) where it starts."""
    out = docs.withColumn("words", F.array_remove(_pieces(F.col("text")), ""))
    out = out.withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("plain", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    empty = F.array().cast("array<int>")
    for k, phrase in enumerate(scan.phrases):
        places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), _starts_with(phrase.split()))
        out = out.withColumn(f"places{k}", F.when(F.contains(F.col("plain"), F.lit(f" {phrase} ")), places).otherwise(empty))
    return out.drop("plain")


def scan_documents(docs: DataFrame, scan: LicenseScan = LicenseScan()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    names = [f"places{k}" for k in range(len(scan.phrases))]
    own = phrase_places(docs.select("doc_id", "text"), scan)
    every = F.concat(*names)
    labels = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, scan.phrases.values(), strict=True)]))
    own = own.withColumn("tokens", F.array_intersect("words", _strings(scan.vocabulary()))).withColumn("can", _candidates(scan, F.col("tokens")))
    own = cut(
        own.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"),
            F.when(F.col("can"), F.col("tokens")).alias("tokens"), F.when(F.col("can"), F.col("text")).alias("text"),
        ),
        "scanned",
    )
    texts = own.where("text is not null").select("row", "tokens", "text")
    order = word_order(texts, scan)
    found = matches(texts, scan, order).unionByName(wrapped_matches(texts, scan, order))
    more = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = own.drop("tokens", "text").join(more, "row", "left")
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(scan: LicenseScan = LicenseScan()) -> str:
    """The rows by trying every template on every line; notices wrapped over lines are not in it."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"
    places = ", ".join(
        f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f'w[i + {d}] = {part!r}' for d, part in enumerate(p.split(), 1))}) AS p{k}" for k, p in enumerate(scan.phrases)
    )
    names = [f"p{k}" for k in range(len(scan.phrases))]
    every = " || ".join(names)
    base = " || ".join(f"CASE WHEN len({n}) > 0 THEN ['{label}'] ELSE [] END" for n, label in zip(names, scan.phrases.values(), strict=True))
    templates = ", ".join(
        f"('{label}', {quoted(words)}, {len(words)}, {need}, {quoted(must)}, [{', '.join(map(quoted, without))}]::VARCHAR[][])"
        for (_, label, words, need), (must, without) in zip(scan.sets(), scan.relatives(), strict=True)
    )
    split = r"list_filter(string_split_regex({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    apart = "len(list_intersect(s, must)) = len(must) AND len(list_filter(without, lambda o: len(list_intersect(s, o)) = len(o))) = 0"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT row_id, doc_id, {split.format(t='t')} AS w FROM d),
p AS (SELECT row_id, doc_id, len(w) AS n_words, {places} FROM w),
b AS (SELECT *, {every} AS places, {base} AS base FROM p),
tmpl(label, words, m, need, must, without) AS (VALUES {templates}),
lines AS (SELECT row_id, list_distinct({split.format(t='l')}) AS s FROM (SELECT row_id, unnest(string_split(t, chr(10))) AS l FROM d)),
found AS (SELECT row_id, label, max(len(list_intersect(s, words)) / CAST(m AS DOUBLE)) AS c FROM lines, tmpl WHERE len(list_intersect(s, words)) >= need AND {apart} GROUP BY ALL),
more AS (SELECT row_id, list(label) AS more, max(c) AS best FROM found GROUP BY row_id)
SELECT b.doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN more USING (row_id)"""


SQL = _sql()
