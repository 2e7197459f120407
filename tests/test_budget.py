from loomstone.functions import budget
from loomstone.functions import retrieval as r
from pyspark.sql import functions as F


def test_scores_equal_the_native_ones(spark):
    texts = ["Política y más", "the policy politica policy", "nothing here", "policy"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, idx int, text string")
    native = [x["score"] for x in r.bm25(df, "política policy").orderBy("idx").collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(native, budget.scores(texts, r.query_terms("política policy")), strict=True))


def test_fit(spark):
    md = "# Intro\n\n" + "filler words go on. " * 30 + "\n\n# Rates\n\nThe rate limit is sixty a minute.\n\n" + "more filler. " * 30
    got = budget.fit(md, 200, "what is the rate limit?")
    assert got["selection"] == "bm25" and got["text"] == "# Rates\n\nThe rate limit is sixty a minute."
    assert budget.fit(md, 200, "zebra")["selection"] == "head" and budget.fit(None, 5) == {"text": "", "omitted": 0, "selection": "whole"}
    df = spark.createDataFrame([(md,), ("short",), (None,)], "t string").select(budget.budgeted(F.col("t"), 200, "rate limit").alias("b")).collect()
    assert [x["b"]["selection"] for x in df][:2] == ["bm25", "whole"]
