import math
import random
import re

from lumigrid.llm import licenses as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def need(t, scan):
    return math.ceil(scan.threshold * len(t) - 1e-9)


def of_a_relative(have, t, label, scan):
    """Whether a template near enough to be taken for t tells the block apart from it."""
    for other, text in scan.templates:
        o = set(text.split())
        if other != label and len(t & o) >= need(t, scan):
            if not t - o <= have or (t < o and o - t <= have):
                return True
    return False


def in_order(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(line[j - 1] + 1 if x == y else max(line[j], new[-1]))
        line = new
    return line[-1]


def brute(text, scan):
    w = words(text)
    places, labels = [], set()
    for phrase, label in scan.phrases.items():
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    more, best = set(labels), 0.0
    for line in (text or "").split("\n"):
        have = set(words(line))
        for label, template in scan.templates:
            t = set(template.split())
            shared = len(have & t)
            if shared >= need(t, scan) and not of_a_relative(have, t, label, scan):
                more.add(label)
                best = max(best, shared / len(t))
    for label, template in scan.templates:
        seq = template.split()
        t = set(seq)
        for at in (i for i, x in enumerate(w) if x in t and len(t & set(w)) >= need(t, scan)):
            own = w[at : at + len(seq)]
            shared = len(set(own) & t)
            if shared >= need(t, scan) and in_order(own, seq) >= math.ceil(scan.threshold * len(seq) - 1e-9) and not of_a_relative(set(own), t, label, scan):
                more.add(label)
                best = max(best, shared / len(t))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if labels else best)


def corpus():
    rnd = random.Random(9)
    rows = []
    for k in range(300):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            how = rnd.random()
            if how < 0.3:
                line = rnd.choice(L.TEMPLATES)[1].split()
                for _ in range(rnd.randint(0, 3)):
                    line[rnd.randrange(len(line))] = rnd.choice(["zzz", "the", "License"])
                parts.append(rnd.choice([" ", ", ", "-"]).join(line))
            elif how < 0.5:
                parts.append(rnd.choice(["Released UNDER the MIT license.", "Licensed under CC BY-NC 4.0", "cc by nc cc by nc", "Apache License, Version 2.0", "under the\nmit license"]))
            else:
                parts.append(" ".join(rnd.choice(["the", "of", "à", "license", "word", "2"]) for _ in range(rnd.randint(1, 30))))
        rows.append((k, "\n".join(parts)))
    return rows + [(900, None), (901, ""), (902, "É mit" * 5000), (903, " -- \n"), (904, "x " * 20000 + "under the mit license"), (3, rows[3][1]), (None, "Released under the MIT License")]


def test_against_brute_force(spark):
    rows = corpus()
    for threshold in (0.9, 0.7):
        scan = L.LicenseScan(threshold=threshold)
        out = L.scan_documents(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string"), scan).collect()
        key = lambda r: tuple((x is None, x) for x in r)
        got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in out), key=key)
        assert got == sorted(((i, *brute(t, scan)) for i, t in rows), key=key)


def test_empty(spark):
    assert L.scan_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software"
    bsd = "# Redistribution and use in source and binary forms, with or\n# without modification, are permitted provided that the\n# following conditions are met:"
    apache = "\n * you may not use this file except in compliance\n * with the License.\n * You may obtain a copy of the License at"
    gpl = "This is licensed under the GNU\r\nGeneral Public License,\r\nversion 3."
    rows = [
        (1, mit, "mit"), (2, bsd, "bsd"), (3, "text\n" * 50 + apache, "apache-2"), (4, gpl, "gpl-3"),
        (10, gpl.replace("\r\n", " "), "gpl-3"), (11, gpl.replace("General", "Affero General"), "agpl-3"), (12, gpl.replace("\r\n", " ").replace("General", "Lesser General"), "lgpl-3"),
        (13, gpl + "\n" + gpl.replace("General", "Affero General"), "agpl-3,gpl-3"),
        (5, mit.replace("hereby", "now"), "mit"),  # 18 of 19 words
        (6, mit.replace("hereby", "now").replace("charge", "cost"), ""),
        (7, "license version 3\nlicensed under the gnu general public", ""),  # not in order
        (8, "\n".join([mit, bsd]), "bsd,mit"),
        (9, "\n".join(["the of to any a copy"] * 3000 + [mit]), "mit"),
    ]
    out = L.scan_documents(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in out} == {i: want for i, _, want in rows}
    assert {r.doc_id: r.score for r in out}[5] == 18 / 19 and {r.doc_id: r.score for r in out}[1] == 1.0


def test_wrapped_long_template(spark):
    long = " ".join(f"w{i}" for i in range(90))
    scan = L.LicenseScan(templates=(("long", long),))
    docs = spark.createDataFrame([(1, long.replace("w9 ", "x\n").replace("w50 ", "w50\n"))], "doc_id long, text string")
    assert [(r.labels, r.score) for r in L.scan_documents(docs, scan).collect()] == [("long", 89 / 90)]


def test_labels_are_those_of_the_own_row(spark):
    """Rows without or with a shared doc_id don't get each other's labels."""
    gpl = "licensed under the GNU General Public License version 3"
    rows = [(None, "plain prose here"), (None, gpl), (None, None), (5, "more prose"), (5, gpl), (5, gpl)]
    out = L.scan_documents(spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id int, text string, row int, tokens string, base string").repartition(3)).collect()
    assert sorted(((r.doc_id or -1, r.n_words, r.labels) for r in out)) == [(-1, 0, ""), (-1, 3, ""), (-1, 9, "gpl-3"), (5, 2, ""), (5, 9, "gpl-3"), (5, 9, "gpl-3")]


def test_every_template_gets_its_own_label_alone(spark):
    for wrap in (lambda t: t, lambda t: "\n".join(t.split(" ", 4))):
        rows = [(i, wrap(t)) for i, (_, t) in enumerate(L.TEMPLATES)]
        out = {r.doc_id: r.labels for r in L.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out == {i: label for i, (label, _) in enumerate(L.TEMPLATES)}


def test_only_ascii_is_lowered(spark):
    rows = [(1, "under the M\u0130T license"), (2, "released under the mit LICEN\u017fE"), (3, "\u212aEY under THE mit License \u212a")]
    out = {r.doc_id: (r.n_words, r.labels) for r in L.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (4, ""), 2: (5, ""), 3: (6, "mit")}
    scan = L.LicenseScan(templates=(("k", "a k b"),), phrases={"k a": "p"})
    assert [r.labels for r in L.scan_documents(spark.createDataFrame([(1, "a \u212a b \u212a a")], "doc_id long, text string"), scan).collect()] == [""]
