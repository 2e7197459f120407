import re

from loomstone.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [
    (1, "Licensed under the Apache License, Version 2.0. Released Under the MIT License; CC BY-NC CC by nc"),
    (2, None),
    (3, ""),
    (4, "This work is licensed under the GNU General Public License, version 3."),
    (5, "this work is truly licensed under the gnu general public license version 3 " + "x " * 3000),
    (6, "gnu general public. This license is a work under version 3 the licensed"),
    (7, "underK the mit license é MİT under the mit"),
    (None, "Licensed under CC BY 4.0."),
    (8, "released under the mit license released under the mit license"),
]


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    base = sorted((i, lab) for p, lab in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    spans = set()
    for label, ts in L.TEMPLATES.items():
        for t in ts:
            t = t.split()
            diagonals = {}
            for i in range(len(w) - 2):
                for j in range(len(t) - 2):
                    if w[i : i + 3] == t[j : j + 3]:
                        diagonals.setdefault(i - j, []).append((i, j))
            chains, last = [], None
            for d in sorted(diagonals):
                if last is not None and d - last <= L.DRIFT:
                    chains[-1] += diagonals[d]
                else:
                    chains.append(list(diagonals[d]))
                last = d
            keys = [[j for j in range(len(t) - 2) if any(t[j + x : j + x + len(k)] == k for x in range(4 - len(k)))] for k in map(str.split, L.KEYS)]
            for c in chains:
                held, at = [], -1
                for j, i in sorted((j, i) for i, j in c):
                    if (not held or j > held[-1]) and i > at:
                        held.append(j)
                        at = i
                first, last = min(i for i, _ in c), max(i for i, _ in c) + 2
                fits = last - first + 1 <= L.LONGEST * len(t) + L.SLACK
                if len(held) / (len(t) - 2) >= L.COVER and fits and all(set(k) & set(held) for k in keys if k):
                    spans.add((label, len(held) / (len(t) - 2), len(held), first, last))
    spans = {(a, x) for a, x, n, f, t in spans if not any(m > n and g <= t and f <= u for _, _, m, g, u in spans)}
    labels = {lab for _, lab in base}
    return (
        len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)),
        ",".join(sorted(labels | {lab for lab, _ in spans})), 1.0 if base else max((c for _, c in spans), default=0.0),
    )


def check(df, rows):
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert df.columns == names
    assert sorted(map(tuple, df.collect()), key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in ROWS], "doc_id bigint, text string, row string").repartition(3)
    out = L.license_digest(docs)
    check(out, ROWS)
    assert "Python" not in out._jdf.queryExecution().toString()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[4]["labels"] == by[5]["labels"] == "gpl-3" and by[6]["labels"] == "" and by[None]["labels"] == "cc-by"


def test_near_licences_are_told_apart(spark):
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    gnu = "Licensed under the GNU {}General Public License, version {}."
    rows = [
        (gnu.format("", 3), "gpl-3"),
        (gnu.format("", 2), "gpl-2"),
        (gnu.format("", 1), ""),
        ("This work is l" + gnu.format("Library ", 3)[1:], ""),
        (cc.format(""), "cc-by"),
        (cc.format("-NoDerivatives"), "cc-by-nd"),
        (cc.format("-NonCommercial"), "cc-by-nc"),
        (cc.format("-ShareAlike"), "cc-by-sa"),
        (cc.format("-NonCommercial-ShareAlike"), "cc-by-nc-sa"),
        (cc.format("-NonCommercial-NoDerivatives"), "cc-by-nc-nd"),
        ("Licensed under CC BY-ND 4.0", "cc-by-nd"),
        (gnu.format("Lesser ", 3), "lgpl-3"),
        (gnu.format("Lesser ", "2.1"), "lgpl-2.1"),
        (gnu.format("Affero ", 3), "agpl-3"),
        *((re.sub(" ", "\n * ", " ".join(t), count=9), label) for label, ts in L.TEMPLATES.items() for t in [ts[0].split()] if label not in ("mit", "bsd") and not label.startswith("cc-by-nc")),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software " * 2, ""),
        (" ".join(sorted(L.TEMPLATES["isc"][0].split())), ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in L.license_digest(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [x for _, x in rows]


def test_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(L.license_digest(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_shuffled_text_is_no_licence(spark):
    """Every gram of a template, but in blocks that are out of order, covers it and is not aligned."""
    words = L.TEMPLATES["gpl-3"][2].split()
    blocks = [words[i : i + 9] for i in range(0, len(words) - 8, 4)]
    texts = [" ".join(words), " ".join(w for b in reversed(blocks) for w in b), " pad ".join(" ".join(words[i : i + 3]) for i in range(len(words) - 2))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in L.license_digest(docs).collect()}
    assert got == {0: "gpl-3", 1: "", 2: ""}


def test_many_templates_need_no_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t) for d, t in ROWS], "doc_id bigint, text string")
    want = sorted(map(tuple, L.license_digest(docs).collect()), key=str)
    monkeypatch.setattr(L, "FEW_GRAMS", 0)
    assert sorted(map(tuple, L.license_digest(docs).collect()), key=str) == want


def test_empty_table(spark):
    assert L.license_digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
