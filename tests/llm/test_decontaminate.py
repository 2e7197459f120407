import random

from loomstone.llm import decontaminate as d


def edit_distance_within(passage, text):
    """Fewest edits from passage to any part of text (Sellers)."""
    now = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        last, now = now, [i]
        for j, t in enumerate(text, 1):
            now.append(min(last[j - 1] + (c != t), last[j] + 1, now[j - 1] + 1))
    return min(now)


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        t = d.normalize(text)
        for item_id, item in items:
            for w in d.windows(d.normalize(item)):
                e = edit_distance_within(w, t) if len(t) >= len(w) // 2 else 99
                if e <= d.budget(len(w)):
                    out[doc_id, item_id] = min(e, out.get((doc_id, item_id), 99))
    return out


def damaged(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice([[], ["x"], [s[i], "y"]])
    return "".join(s)


def test_distance():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randrange(12, 60)))
        k = rng.randrange(0, 6)
        r = "".join(rng.choice("abc") for _ in range(rng.randrange(0, k + 1))) + damaged(rng, p, rng.randrange(8)) + "ab"[: rng.randrange(3)]
        want = edit_distance_within(p, r)
        assert d.distance(p, r, k) == (want if want <= k else None), (p, r, k)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgéñ漢") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randrange(3, 60))) for i in range(25)] + [(90, None), (91, ""), (92, "short"), (None, say(30))]
    docs = [(i, say(rng.randrange(0, 60))) for i in range(10)]
    for i in range(30):
        item = rng.choice(items[:25])[1]
        part = item if i % 3 else item[len(item) // 4 :]
        docs.append((100 + i, say(20).upper() + " \n " + damaged(rng, part.upper(), rng.randrange(0, 10)) + "\t" + say(15)))
    docs += [(None, items[0][1]), (7000, items[1][1]), (7000, items[1][1]), (300, None), (301, "")]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in d.find_leaks(df, bench).collect()}
    want = brute(docs, items)
    assert got == want and len(got) > 15
    kept = d.without_leaks(df, bench)
    assert kept.columns == df.columns
    dirty = {k for k, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(k) for k, _ in docs if k not in dirty)


def test_any_short_excerpt_and_reworded_copies(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(45)) for i in range(40)]
    docs = []
    for i, text in items:
        at = rng.randrange(len(text) - 50)
        docs.append((i, f"QQQ {text[at : at + 50]} ZZZ"))
        words = text.split()
        for w in rng.sample(range(45), 5):
            words[w] = rng.choice(vocab)
        docs.append((1000 + i, " ".join(words)))
    docs += [(2000 + i, say(300)) for i in range(20)]
    docs.append((3000, items[0][1][8:172]))
    out = d.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in out.collect()}
    assert got == {(i, i) for i in range(40)} | {(1000 + i, i) for i in range(40)} | {(3000, 0)}


def test_several_passes_agree(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, d.find_leaks(docs, bench).collect()))
    texts = [(r["doc_id"], d.normalize(r["text"])) for r in docs.collect()]
    exact = {(k, b["item_id"]) for b in bench.collect() for k, t in texts if d.normalize(b["text"]) in t}
    assert exact <= {(a, b) for a, b, _ in one} and len(exact) > 0
    monkeypatch.setattr(d, "INDEX_CHARS", 2000)
    assert sorted(map(tuple, d.find_leaks(docs, bench).collect())) == one


def test_long_texts_and_frequent_grams(spark, monkeypatch):
    """A long text in pieces, and a stem that all items share, find what one piece finds."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghiklmno") for _ in range(6)) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, "choose the right answer from the list below " + say(12)) for i in range(60)] + [(99, "blue owl")]
    parts = [say(400), items[3][1], say(3000), damaged(rng, items[7][1], 2), say(500), "x blue owl y", say(100)]
    long = " ".join(parts) + " choose the right answer from the list below" * 40
    index = d.Index(items)
    want = {(r, i): min(e for a, b, e in index.search([long, "no"]) if (a, b) == (r, i)) for r, i, _ in index.search([long, "no"])}
    assert {3, 7, 60} <= {i for _, i in want}
    for name, value in (("PIECE", 700), ("HITS", 500), ("LEAST_PIECE", 150)):
        monkeypatch.setattr(d, name, value)
        got = {}
        for r, i, e in index.search([long, "no"]):
            got[r, i] = min(e, got.get((r, i), 99))
        assert got == want, name


def test_pieces_overlap():
    text = "".join(chr(97 + i % 26) for i in range(1003))
    for size in (150, 333, 1002, 1003, 2000):
        got = d.pieces(text, size)
        assert all(len(p) <= size for p in got) and got[0] == text[:size] and text.endswith(got[-1])
        assert all(any(text[s : s + d.OVERLAP] in p for p in got) for s in range(len(text) - d.OVERLAP + 1))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert d.find_leaks(none, bench).count() == 0 and d.find_leaks(some, bench).count() == 0
    assert d.without_leaks(some, bench).count() == 1
