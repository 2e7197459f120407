"""Search hits and lists of pages, joined with what was fetched for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.retrieval import term_coverage
from loomstone.functions.urls import host, url_words

#: What a search may ask for (fixed values).
LEAST_HITS, MOST_HITS = 1, 20
#: How many pages of a host are fetched at once (fixed value).
PER_HOST = 2


def hit_limit(wanted: int) -> int:
    """The limit of a search, within its bounds."""
    return min(MOST_HITS, max(LEAST_HITS, wanted))


def link_score(url: Column, query: str, page_relevance: Column) -> Column:
    """How well a link fits a query: coverage by its words, plus half of what the page that holds it has, to four places."""
    return F.round(term_coverage(url_words(url), query) + 0.5 * F.coalesce(page_relevance, F.lit(0.0)), 4)


def hits_with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """``hits`` (query_id, rank, ...) with the document of the same query and rank, its columns null where there is none."""
    return hits.join(documents, ["query_id", "rank"], "left")


def chunks_with_scores(chunks: DataFrame, scores: DataFrame, key: str = "page_id") -> DataFrame:
    """``chunks`` (key, id, ...) with the score at the same place; 0 where there is none."""
    return chunks.join(scores.select(key, "id", "score"), [key, "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def scrape_many(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """(seq, url, html, error, wave) of a list of URLs, each on its own: one that fails leaves the others alone.

    wanted: seq, url.  pages: url, html, error of what was fetched.  ``wave``
    counts a host's pages in PER_HOSTs, in order of the list, for fetchers that are polite.
    """
    place = F.row_number().over(Window.partitionBy(host(F.col("url"))).orderBy("seq"))
    got = pages.select("url", "html", "error", F.lit(True).alias("_got"))
    error = F.when(F.col("_got").isNull(), "not fetched").otherwise(F.col("error"))
    listed = wanted.select("seq", "url", F.floor((place - 1) / PER_HOST).cast("int").alias("wave"))
    return listed.join(got, "url", "left").select("seq", "url", F.when(error.isNull(), F.col("html")).alias("html"), error.alias("error"), "wave")


def search_then_scrape(hits: DataFrame, pages: DataFrame, limit: int, allowed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The best hits of each query with their pages, and the hits that may not be fetched.

    hits: query_id, rank, url.  ``limit`` is cut to its bounds; ranks are counted
    anew among the hits that are ``allowed``.
    """
    ok = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    w = Window.partitionBy("query_id").orderBy("rank")
    best = hits.filter(ok).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= hit_limit(limit))
    got = best.join(pages.select("url", "html", "error"), "url", "left").select("query_id", "place", "url", "html", "error")
    return got, hits.filter(~ok).select("query_id", "rank", "url")
