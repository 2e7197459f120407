import random
import re

import numpy as np
import pyarrow as pa

from loomstone.llm import neardup
from loomstone.llm.components import components
from loomstone.llm.textarrays import column_bytes, shingle_sets, word_hashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted(
        ((d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for d, s in sets),
        key=lambda r: (r[0] is None, r),
    )


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_words_and_sets():
    texts = ["", None, "One two", "\n a b\tc\x0bd e f A B c D e f ", "é ü\x1cx", "end"]
    data, offsets = column_bytes(pa.array(texts))
    starts, ends, first = words(data, offsets)
    mine = [[data[starts[i] : ends[i]].tobytes().decode() for i in range(first[r], first[r + 1])] for r in range(len(texts))]
    assert mine == [WORD.findall(t or "") for t in texts]
    _, bounds = shingle_sets(data, offsets)
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    assert (word_hashes(data, starts, ends) == word_hashes(data, starts, ends, block=2)).all()


def family(rng, words_, n, rate):
    base = [rng.choice(words_) for _ in range(120)]
    for _ in range(n):
        yield " ".join(rng.choice(words_) if rng.random() < rate else w for w in base)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    texts = ["", " \n", None, "one two", "One TWO", "one two three", *["same text in many copies " * 3] * 40]
    for rate in (0.005, 0.015, 0.02, 0.025, 0.03):
        texts += family(rng, vocab, 40, rate)
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, "one two"), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, node int, component int")
    assert got(neardup.near_duplicates(docs.repartition(4))) == brute(rows)


def test_small_blocks_agree(spark, monkeypatch):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    rows = list(enumerate(family(rng, vocab, 90, 0.028)))
    monkeypatch.setattr(neardup, "BLOCK", 7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(neardup.near_duplicates(docs)) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id bigint, text string")
    assert got(neardup.near_duplicates(docs)) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 102), (102, 101), (101, 100), (7, 7), (200, 201), (200, 202), (200, 203)]
    out = dict(components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert {v for k, v in out.items() if k <= 60} == {1} and len(out) == 60 + 3 + 4
    assert out[102] == 100 and out[203] == 200


def test_query_equals_its_sql(spark, sf):
    import duckdb
    from loomstone.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(ORACLES["op2_near_duplicates"])
    names = [d[0] for d in cur.description]
    df = QUERIES["op2_near_duplicates"](spark, sf)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cur.fetchall())
