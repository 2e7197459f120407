"""Scoring extraction: recall and noise of expected strings, consensus between tools, paired tests."""

from __future__ import annotations

import difflib
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mcnemar_p(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided p-value of a paired comparison: the smaller side of a fair coin, doubled.

    The greatest term of the sum comes from logarithms, the others from their ratios to the one before.
    """
    n, k = (a_only + b_only).cast("double"), F.least(a_only, b_only).cast("int")
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    top = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.ln((n - k + i) / i)) - (n - 1) * log(2)
    total = F.aggregate(
        F.reverse(steps), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * i / (n - i + 1)).alias("term"), (a["sum"] + a["term"] * i / (n - i + 1)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def paired_counts(results: DataFrame) -> DataFrame:
    """(a, b, a_only, b_only, p): pages that one tool read and the other did not; results: (tool, page, ok)."""
    left = results.select("page", F.col("tool").alias("a"), F.col("ok").alias("a_ok"))
    right = results.select("page", F.col("tool").alias("b"), F.col("ok").alias("b_ok"))
    both = left.join(right, "page").filter("a < b")
    counts = both.groupBy("a", "b").agg(F.count_if(F.col("a_ok") & ~F.col("b_ok")).alias("a_only"), F.count_if(F.col("b_ok") & ~F.col("a_ok")).alias("b_only"))
    return counts.withColumn("p", mcnemar_p(F.col("a_only"), F.col("b_only")))


def sentences(text: Column, least: int = 50) -> Column:
    """Distinct sentences of ``least`` characters or more, markup and case dropped."""
    plain = F.transform(
        F.split(text, r"(?<=[.!?。！？])\s+|\n+"),
        lambda s: F.lower(F.btrim(F.regexp_replace(F.regexp_replace(s, "[#>|*_`]", " "), r"(?U)\s+", " "))),
    )
    return F.array_distinct(F.filter(plain, lambda s: F.length(s) >= least))


def consensus(outputs: DataFrame, tools: int = 2) -> DataFrame:
    """(tool, page, recall): share of the sentences that at least ``tools`` tools have, which a tool has; outputs: (tool, page, text)."""
    each = outputs.select("tool", "page", F.explode(sentences(F.col("text"))).alias("s"))
    agreed = each.groupBy("page", "s").agg(F.count("*").alias("n")).filter(F.col("n") >= tools)
    hits = each.join(agreed, ["page", "s"], "left_semi").groupBy("tool", "page").agg(F.count("*").alias("hit"))
    total = agreed.groupBy("page").agg(F.count("*").alias("total"))
    return outputs.select("tool", "page").join(total, "page").join(hits, ["tool", "page"], "left").select(
        "tool", "page", (F.coalesce("hit", F.lit(0)) / F.col("total")).alias("recall")
    )


def signal_scores(pages: DataFrame) -> DataFrame:
    """(name, recall, leakage): expected strings found and excluded ones found; pages: (name, text, expected, excluded)."""
    def share(column: str) -> Column:
        found = F.size(F.filter(column, lambda s: F.contains(F.lower("text"), F.lower(s))))
        return F.when(F.size(column) > 0, found / F.size(column))

    return pages.select("name", F.coalesce(share("expected"), F.lit(1.0)).alias("recall"), F.coalesce(share("excluded"), F.lit(0.0)).alias("leakage"))


def quality_score(missing: Column, leaked: Column, missing_meta: Column, structure: Column) -> Column:
    """100 less a penalty for each fault, 0 at least."""
    return F.greatest(F.lit(0), 100 - 12 * missing - 15 * leaked - 6 * missing_meta - 8 * structure)


def diff(old: str, new: str, limit: int = 400) -> dict:
    """Unified diff with one line of context: added, removed, the first ``limit`` lines, and whether it was cut."""
    lines = list(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), "previous", "current", lineterm="", n=1))
    count = lambda sign: sum(x.startswith(sign) and not x.startswith(sign * 3) for x in lines)
    return {"added": count("+"), "removed": count("-"), "diff": "\n".join(lines[:limit]), "cut": len(lines) > limit}


def diffs(pairs: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """``pairs`` as (key, added, removed, diff, cut); only changed rows are compared line by line."""
    run = F.udf(diff, "struct<added:int,removed:int,diff:string,cut:boolean>", useArrow=True)
    same = F.struct(F.lit(0).alias("added"), F.lit(0).alias("removed"), F.lit("").alias("diff"), F.lit(False).alias("cut"))
    return pairs.select(key, F.when(F.col(old).eqNullSafe(F.col(new)), same).otherwise(run(old, new)).alias("d")).select(key, "d.*")


def eligible(sites: DataFrame, per_domain: int = 3, per_kind: int = 6, least_chars: int = 1500) -> DataFrame:
    """Sites (domain, kind, url, chars) with a reason: ok, thin, domain_full or kind_full; urls in order."""
    from pyspark.sql import Window

    fit = F.col("chars") >= least_chars
    by_domain = Window.partitionBy("domain", fit).orderBy("url")
    one = sites.withColumn("_d", F.row_number().over(by_domain)).withColumn("_in", fit & (F.col("_d") <= per_domain))
    two = one.withColumn("_k", F.row_number().over(Window.partitionBy("kind", "_in").orderBy("url")))
    reason = F.when(~fit, "thin").when(~F.col("_in"), "domain_full").when(F.col("_k") > per_kind, "kind_full").otherwise("ok")
    return two.withColumn("reason", reason).drop("_d", "_in", "_k")


def stratified(df: DataFrame, stratum: str, shares: dict, n: int, key: str, seed: int = 7) -> DataFrame:
    """Exactly round(share x n) rows of each stratum (fewer if it has fewer), by the order of a seeded hash."""
    from pyspark.sql import Window

    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, round(v * n))]), F.col(stratum)), F.lit(0))
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= quota).drop("_r")
