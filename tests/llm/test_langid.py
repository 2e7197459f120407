import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomstone.llm import langid as L
from loomstone.llm.textarrays import column_bytes

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["zü", "ß", "och"], "cc": ["ñe", "que", "ción"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def remainder(d):
    return zlib.crc32(str(d).encode()) % 3


def test_windows_cover_every_byte():
    texts = ["", None, "a" * 5, "b" * 192, "c" * 193, "d" * 1000, "é" * 400]
    data, offsets = column_bytes(pa.array(texts))
    got = list(L.cut(data, offsets, at_once=4))
    assert all(len(w) <= 4 for w, _ in got)
    windows, row = (np.concatenate(x) for x in zip(*got, strict=True))
    step = L.WINDOW - max(L.WIDTHS) + 1
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        mine = windows[row == i]
        joined = b"".join(w.tobytes()[: step if k < len(mine) - 1 else L.WINDOW] for k, w in enumerate(mine))
        assert joined.rstrip(b"\0") == raw


def test_gradients():
    rng = np.random.default_rng(1)
    net = L.Network.fresh(["a", "b"])
    windows, labels = rng.integers(0, 256, (6, 20), dtype=np.uint8), np.array([0, 1, 0, 1, 1, 0])
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(6), labels]).mean()
    grads = net.gradients(windows, labels)
    for w, g in zip(net.weights(), grads, strict=True):
        assert w.shape == g.shape
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        eps, old = 1e-2, w[at]
        w[at] = old + eps
        up = loss()
        w[at] = old - eps
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 0.15 * abs(g[at]) + 1e-4


def test_identify(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randrange(5, 200)), lang, "s") for i in range(240) for lang in [rng.choice(list(SYLLABLES))]]
    odd = [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !? 4", "aa", "s"), (None, text(rng, "aa", 30), None, "s"), (1003, text(rng, "bb", 9000), None, "s")]
    docs = spark.createDataFrame(rows + odd + rows[:2], "doc_id bigint, text string, lang string, score string").repartition(3)
    got = L.identify(docs).collect()
    assert len(got) == len(rows) + len(odd) + 2
    by = {r["doc_id"]: r for r in got}
    for d in (1000, 1001, 1002):
        assert (by[d]["lang_pred"], by[d]["score"]) == ("und", 0.0)
    assert by[None]["held_out"] is None and by[None]["lang_pred"] == "aa" and by[1003]["lang_pred"] == "bb"
    right = [by[d]["lang_pred"] == lang for d, _, lang, _ in rows if remainder(d) == 1]
    assert sum(right) / len(right) > 0.97
    assert all(by[d]["held_out"] == (remainder(d) == 1) and 0 <= by[d]["score"] <= 1 for d, *_ in rows)


def test_a_bounded_sample_is_learnt_from(spark):
    docs = spark.range(9000).selectExpr("id doc_id", "concat('ka lo ', id) text", "if(id % 30 = 0, 'bb', 'aa') lang")
    docs = docs.unionByName(spark.range(5000).selectExpr("7L doc_id", "'ka lo 7' text", "'aa' lang"))
    got = [lang for lang, _ in L.training_windows(docs.repartition(5), 100)]
    assert sorted(got) == ["aa"] * 100 + ["bb"] * 100
    assert L.training_windows(docs.repartition(2), 100) == L.training_windows(docs, 100)


def test_long_texts(spark):
    docs = spark.createDataFrame([(1, "ka lo mi " * 700_000, None)], "doc_id bigint, text string, lang string")
    rng = random.Random(2)
    net = L.train(spark.createDataFrame([(i, text(rng, lang, 60), lang) for i in range(60) for lang in SYLLABLES], "doc_id bigint, text string, lang string"))
    assert L.identify(docs, net).first()["lang_pred"] == "aa"


def test_learns_from_the_permitted_rows_only(spark):
    docs = spark.createDataFrame([(i, "ka lo", "aa" if remainder(i) != 1 else "zz") for i in range(30)], "doc_id bigint, text string, lang string")
    assert {lang for lang, _ in L.training_windows(docs)} == {"aa"}


@pytest.mark.parametrize("rows", [[], [(1, "text", None)]])
def test_nothing_to_learn(spark, rows):
    got = L.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == "und" for r in got)


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect() if re.search(r"\w", r["text"])}
    got = [r for r in L.identify(docs).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97
