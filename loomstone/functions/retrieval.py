"""Folding, tokens, BM25 and term coverage in native columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of English and Spanish that queries are not about.
STOP_WORDS = """
a an and are as at be by for from has have how in is it its of on or that the this to was were what when where which
who why will with does do you your
el la los las un una unos unas y o de del al en es son que qué por para con como cómo cuál cuáles cuando dónde se su sus
lo le les mi tu
""".split()
K1, B = 1.5, 0.75


def _strip(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Letters whose decomposition is one letter and marks, by rule over the Latin and Greek blocks.
_MARKED = [chr(c) for c in range(0xC0, 0x400) if len(_strip(chr(c))) == 1 and _strip(chr(c)) != chr(c)]
_FROM, _TO = "".join(_MARKED), "".join(_strip(c) for c in _MARKED)
_TABLE = str.maketrans(_FROM, _TO, "".join(map(chr, range(0x300, 0x370))))
_STOP = sorted({_strip(w) for w in STOP_WORDS})


def fold(text: Column) -> Column:
    """Lower case without accents; letters that expand to several (ligatures) stay."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"[\x{300}-\x{36F}]", "")


def fold_text(text: str) -> str:
    """The same for a Python string, on the driver."""
    return text.lower().translate(_TABLE)


def tokens(text: Column) -> Column:
    """Folded words of two characters or more that are no stop words."""
    return F.filter(
        F.regexp_extract_all(fold(text), F.lit(r"(?U)\w+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(_STOP)
    )


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in order."""
    return list(dict.fromkeys(t for t in re.findall(r"\w+", fold_text(query)) if len(t) > 1 and t not in _STOP))


def term_coverage(text: Column, query: str) -> Column:
    """Share of the query's terms that occur."""
    terms = query_terms(query)
    if not terms:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*map(F.lit, terms)), tokens(text))) / F.lit(float(len(terms)))


def bm25(passages: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``passages`` with a column score: BM25 among the passages of the same key.

    One window over the key gives the counts; a passage carries a number for each
    query term, never its tokens, through the shuffle.
    """
    terms = query_terms(query)
    if not terms:
        return passages.withColumn("score", F.lit(0.0))
    names = [f"_tf{i}" for i in range(len(terms))]
    counted = passages.withColumn("_tokens", tokens(F.col(text))).withColumns(
        {n: F.size(F.filter("_tokens", _is(t))) for n, t in zip(names, terms, strict=True)} | {"_len": F.size("_tokens")}
    ).drop("_tokens")
    w = Window.partitionBy(key)
    counted = counted.withColumns(
        {"_n": F.count("*").over(w), "_avg": F.avg("_len").over(w)}
        | {f"_df{n}": F.sum((F.col(n) > 0).cast("int")).over(w) for n in names}
    )
    mean = F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(1.0)
    total = F.lit(0.0)
    for n in names:
        df = F.col(f"_df{n}")
        idf = F.ln(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        tf = F.col(n)
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / mean))
    return counted.withColumn("score", total).select(*passages.columns, "score")


def _is(term: str):
    return lambda t: t == term


def top_passages(scored: DataFrame, k: int, key: str = "doc_id", order: str = "idx") -> DataFrame:
    """The k best passages of each key, ties by order; the first k where nothing matched."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fixed_chunks(text: Column, size: int, most: int, blank: str = " \t\n\r\x0b\x0c") -> Column:
    """Slices of ``size`` characters, trimmed of the characters ``blank``, empty ones dropped, at most ``most``."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.btrim(F.substring(text, i * size + 1, F.lit(size)), F.lit(blank)))
    return F.slice(F.filter(parts, lambda p: p != ""), 1, most)


def passages_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, text): the non-blank lines of each text."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("idx", "text")).filter(F.btrim("text") != "")
