import random
import zlib

import numpy as np

from loomstone.llm import toxicity as T


def remainder(d):
    return zlib.crc32(str(d).encode()) % 3


def make(rng, i):
    """Toxic only where an insult meets a group: neither word alone says so."""
    words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
    insult, group = rng.random() < 0.5, rng.random() < 0.5
    words += ["Awful!"] * insult + ["martians,"] * group
    rng.shuffle(words)
    return i, " ".join(words), int(insult and group)


def test_pairs_are_learnt():
    rng = random.Random(4)
    rows = [make(rng, i) for i in range(1500)]
    sets = [T.terms(t.encode()) for _, t, _ in rows]
    y = np.array([v for *_, v in rows], dtype=float)
    model = T.calibrated(sets[:1000], y[:1000])
    right = (model.scores(sets[1000:]) >= 0.7) == y[1000:]
    assert right.mean() > 0.95


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = T.Machine(np.array([2, 5, 9]), 0.5, rng.standard_normal(3), rng.standard_normal((3, T.RANK)))
    sets = [np.array([2, 5, 9]), np.array([5, 7]), np.array([], dtype=np.int64), np.array([1])]
    at = {2: 0, 5: 1, 9: 2}
    for s, got in zip(sets, model.margins(sets), strict=True):
        k = [at[x] for x in s.tolist() if x in at]
        want = 0.5 + sum(model.weight[i] for i in k) + sum(model.factor[i] @ model.factor[j] for i in k for j in k if i < j)
        assert abs(got - want) < 1e-9


def test_scores(spark):
    rng = random.Random(4)
    rows = [make(rng, i) for i in range(900)]
    docs = spark.createDataFrame([(d, t, "z") for d, t, _ in rows] + [(5000, None, "z"), (5001, "", "z"), (None, "Awful martians", "z"), (0, rows[0][1], "z")], "doc_id bigint, text string, toxic string").repartition(3)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (7, None), (3, rows[3][2])], "doc_id bigint, toxic int")
    got = T.score_toxicity(docs, labels).collect()
    assert len(got) == 904 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["held_out"] is None and by[None]["predicted"] == 1 and by[5000]["score"] == by[5001]["score"] < 0.7
    out = [(by[d]["predicted"], y) for d, _, y in rows if remainder(d) == 1]
    assert all(by[d]["held_out"] == (remainder(d) == 1) for d, *_ in rows)
    assert sum(p == y for p, y in out) / len(out) > 0.9


def test_held_out_labels_are_not_read(spark):
    rng = random.Random(8)
    rows = [make(rng, i) for i in range(300)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id bigint, text string")
    flip = lambda d, y: 1 - y if remainder(d) == 1 else y
    scores = [
        sorted(map(tuple, T.score_toxicity(docs, spark.createDataFrame([(d, f(d, y)) for d, _, y in rows], "doc_id bigint, toxic int")).collect()))
        for f in (lambda d, y: y, flip)
    ]
    assert scores[0] == scores[1]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, toxic int")
    assert T.score_toxicity(docs, labels).count() == 0
    assert T.score_toxicity(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), labels).first()["predicted"] == 0
