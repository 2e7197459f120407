import random

import corpus_pipeline as p
from loomstone.llm import decontaminate, packing, pii, quality
from loomstone.llm.queries import tokenizer_path
from test_neardup import brute as classes


def test_stages_on_a_made_corpus(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n))
    item = say(40)
    good = say(120)
    rows = [
        (1, good, "en", "s", 0), (2, good + " end", "en", "s", 0), (3, say(80) + " " + item + " " + say(20), "fr", None, 1),
        (4, "short", "en", "s", 0), (5, None, None, None, None), (6, say(70) + " mail a.b@c.de now", "de", "s", 0),
        (7, say(90), None, "s", 0), (7, say(90), "en", "s", 0), (None, say(60), "en", "s", 0), (None, good + " end", "en", "s", 0),
    ]
    rows += [(8, (again := say(70)), "en", "s", 0)] * 2 + [(9, again, "en", "s", 0), (0, again.upper(), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen.append(sorted(str(r["doc_id"]) for r in docs.select("doc_id").distinct().collect()))
    assert seen == [["0", "1", "2", "3", "6", "7", "8", "9", "None"], ["0", "1", "3", "6", "7", "None"], *[["0", "1", "6", "7", "None"]] * 3]
    assert [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out-near-dedup").collect()].count(7) == 2
    clean = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/out-pii").collect()}
    assert clean[6]["text"].endswith("mail [EMAIL] now") and clean[6]["n_chars"] == len(clean[6]["text"])
    assert clean[1]["text"] == good


def test_stages_keep_clashing_columns_and_empty_tables(spark, sf, tmp_path):
    docs = spark.createDataFrame(
        [(1, " ".join(f"w{i}" for i in range(60)), "en", "s", 0, 1.5, 2, "x")],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id double, row int, email string",
    )
    for df, n in ((docs, 1), (docs.limit(0), 0)):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == docs.columns and out.count() == n, name


def test_whole_run_equals_the_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {r["doc_id"] for r in quality.quality_verdicts(docs, labels).filter("kept").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in kept]
    kept = {d for d, _, _, k in classes([(r["doc_id"], r["text"]) for r in rows]) if k}
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()}
    want = kept - leaks
    got = p.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == want
    left = docs.filter(docs.doc_id.isin(list(want)))
    text = pii.find_pii(left).select("doc_id", pii.redacted(pii.F.col("text"), [(k, pii.F.col(k)) for k in pii.KINDS]).alias("text"))
    mine = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    assert mine(got) == mine(packing.pack_documents(text, tokenizer_path()).collect())
