import random
import re
from collections import Counter
from math import comb

from loomstone.llm import quality as q
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    repeat = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
ROWS = [
    (1, "a b c a b c a"),
    (2, None),
    (3, ""),
    (4, " \x0b é ü\x1c# \n\n x\nx\r\nx \nx"),
    (5, "from " * 70),
    (6, " ".join(f"w{i}" for i in range(60)) + " end w1 w2 w3 end"),
    (None, "a b\n" * 40),
    (7, "w " * 30000),
]


def test_features_against_brute_force(spark, sf):
    docs = spark.createDataFrame([(d, t, "en", 5) for d, t in ROWS], "doc_id bigint, text string, lang string, n_words int")
    big = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, big):
        want = sorted(((r["doc_id"], *brute(r["text"])) for r in df.collect()), key=str)
        assert sorted(map(tuple, q.features(df).select("doc_id", *NAMES).collect()), key=str) == want


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 100, 0.1), (5, 2000, 0.0075), (0, 1, 0.5), (7, 7, 0.2), (40, 3000, 0.02), (50, 100, 0.1)]
    for k, n, p in cases:
        got = spark.range(1).select(q.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        assert abs(got - want) < 1e-9 * max(1, want), (k, n, p, got, want)


def made(rng, poor):
    words = [f"word{rng.randrange(5000)}" for _ in range(80)]
    return " ".join(w + "###" if poor else w for w in words)


def tail(k, n, p):
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0


def reference_cutoffs(rows):
    """The method with plain lists, given which rows propose."""
    plans = {}
    for s in {r["stratum"] for r in rows}:
        mine = [r for r in rows if r["stratum"] == s and r["proposes"]]
        best = []
        for f in q.FEATURES:
            gains = [(sum((1 - (q.PRICE + 1) * r["quality"]) * (r[f] > c) for r in mine), c) for c in q.GRID]
            if max(gains)[0] > 0:
                best.append((-max(gains)[0], f, max(gains)[1]))
        if best:
            plans[s] = sorted(best)
    out = {}
    for s, plan in plans.items():
        good = [r for r in rows if r["stratum"] == s and not r["proposes"] and r["quality"] == 1]
        for k, (_, f, c) in enumerate(plan):
            lost = sum(any(r[g] > d for _, g, d in plan[: k + 1]) for r in good)
            if not good or tail(lost, len(good), q.RISK) > q.DELTA / len(plans):
                break
            out[s, f] = (c, len(good), lost)
    return out


def test_cutoffs_and_verdicts(spark):
    rng = random.Random(1)
    shout = lambda t: " ".join(w.upper() if i % 3 else w for i, w in enumerate(t.split()))
    rows = []
    for i in range(1500):
        poor, stratum = i % 10 == 0, ["big", "small", "big", "mid"][i % 4] if i % 16 < 8 else "big"
        t = made(rng, poor and i % 20 == 0)
        rows.append((i, shout(t) if poor and i % 20 else t, stratum, int(not poor)))
    rows[12] = (12, made(rng, True), "big", 1)  # a good one that looks poor
    rows += [(5000 + i, rows[1][1], "small", 1) for i in range(300)]  # copies count once
    docs = spark.createDataFrame([(d, t, s) for d, t, s, _ in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(d, y, "x") for d, _, _, y in rows] + [(None, 1, "x"), (5, None, "x"), (6, 7, "x")], "doc_id bigint, quality int, lang string")
    measured = q.features(docs)
    drawn = [r.asDict() for r in q.labelled(measured, labels).collect()]
    assert len(drawn) < 1501
    got = {(r["stratum"], r["feature"]): (r["cutoff"], r["good"], r["good_out"]) for r in q.thresholds(measured, labels).collect()}
    assert got == reference_cutoffs(drawn)
    assert {k for k in got if k[0] == "big"} == {("big", "symbol_share"), ("big", "upper_share")} and ("small", "symbol_share") not in got
    out = q.quality_verdicts(docs, labels)
    assert "Python" not in out._jdf.queryExecution().toString()
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[d] == (y == 1) for d, _, s, y in rows if s == "big" and d != 12) and not kept[12]
    extra = docs.withColumn("n_words", F.lit("clash")).withColumn("loomstone_quality", F.lit(1))
    mine = q.keep_good(extra, labels)
    assert mine.columns == extra.columns and {r["doc_id"] for r in mine.collect()} == {d for d, k in kept.items() if k}


def test_good_documents_are_rarely_lost(spark):
    """The promise on fresh rows: over several draws of labels, the loss stays within the risk."""
    rng = random.Random(3)
    noisy = lambda i, p: (i, "", " ".join(f"w{rng.randrange(9000)}" + ("#" if rng.random() < p else "") for _ in range(60)))
    broken = 0
    for turn in range(3):
        good = [noisy(i, rng.random() * 0.5) for i in range(900)]
        poor = [noisy(1000 + i, 0.3 + rng.random() * 0.7) for i in range(400)]
        docs = spark.createDataFrame(good + poor, "doc_id bigint, lang string, text string")
        labels = spark.createDataFrame([(d, int(d < 1000)) for d, _, _ in good[:500] + poor[:200]], "doc_id bigint, quality int")
        kept = {r["doc_id"] for r in q.quality_verdicts(docs, labels).filter("kept").select("doc_id").collect()}
        assert any(d not in kept for d, _, _ in poor)
        broken += sum(d not in kept for d, _, _ in good[500:]) > (q.RISK + 0.02) * 400
    assert broken == 0


def test_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    out = q.quality_verdicts(docs.unionByName(docs), labels)
    assert out.count() == 2 * len(ROWS) and {r["doc_id"] for r in out.filter("kept").collect()} == {6}
    assert q.quality_verdicts(docs.limit(0), labels).count() == 0
