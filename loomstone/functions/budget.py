"""Fitting Markdown into a budget: the blocks that a query wants, else the head."""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.passages import blocks, within_budget
from loomstone.functions.retrieval import _STOP, B, K1, fold_text, query_terms

RESULT = "struct<text:string,omitted:bigint,selection:string>"


def scores(passages: list[str], terms: list[str]) -> list[float]:
    """BM25 of passages among each other."""
    bags = [[t for t in re.findall(r"\w+", fold_text(p)) if len(t) > 1 and t not in _STOP] for p in passages]
    mean = sum(map(len, bags)) / max(1, len(bags)) or 1.0
    out = [0.0] * len(bags)
    for term in terms:
        tf = [bag.count(term) for bag in bags]
        df = sum(n > 0 for n in tf)
        idf = log(1 + (len(bags) - df + 0.5) / (df + 0.5))
        out = [s + idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(bag) / mean)) for s, n, bag in zip(out, tf, bags, strict=True)]
    return out


def fit(md: str | None, limit: int, query: str = "") -> dict:
    """text, how many characters were left out, and how it was chosen: whole, bm25 or head."""
    md = md or ""
    if limit <= 0 or len(md) <= limit:
        return {"text": md, "omitted": 0, "selection": "whole"}
    terms = query_terms(query)
    best = within_budget(md, scores(list(blocks(md)), terms), limit) if terms else None
    if best is not None:
        return {"text": best, "omitted": max(0, len(md) - len(best)), "selection": "bm25"}
    return {"text": md[:limit], "omitted": len(md) - limit, "selection": "head"}


def budgeted(md: Column, limit: int, query: str = "") -> Column:
    """:func:`fit` as a column; texts that fit, and all without a query, stay native."""
    short = F.struct(md.alias("text"), F.lit(0).cast("bigint").alias("omitted"), F.lit("whole").alias("selection"))
    if limit <= 0:
        return short
    head = F.struct(F.substring(md, 1, limit).alias("text"), (F.length(md) - limit).cast("bigint").alias("omitted"), F.lit("head").alias("selection"))
    long = F.udf(lambda t: fit(t, limit, query), RESULT, useArrow=True)(md) if query_terms(query) else head
    return F.when(F.length(md) <= limit, short).otherwise(long)
