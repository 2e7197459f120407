"""Walking link graphs: a driver loop of supersteps, the frontier and the visited set as tables.

Fetching is a source; here pages are rows and links are edges.  Each level joins
the frontier with the edges, keeps what is not known yet, and is written to the
shared folder, so lineage stays short and a lost executor repeats one level.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import urls
from loomstone.runtime import persist_table


def breadth_first(edges: DataFrame, roots: DataFrame, max_depth: int, allow: Column | None = None) -> DataFrame:
    """(root, url, depth): what can be reached from each root within ``max_depth`` links.

    edges: (src, dst).  roots: (root).  allow: a filter over the column url.
    A page is reached at its least depth; the roots themselves at 0.
    """
    visited = persist_table(roots.select("root", F.col("root").alias("url"), F.lit(0).alias("depth")).distinct(), "visited")
    front = visited
    for depth in range(1, max_depth + 1):
        new = front.join(edges, front.url == edges.src).select("root", F.col("dst").alias("url")).distinct()
        if allow is not None:
            new = new.filter(allow)
        front = persist_table(new.join(visited, ["root", "url"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    return visited


def limited_crawl(edges: DataFrame, root: str, page_limit: int, max_depth: int, fetched: DataFrame | None = None, attempts: int = 1, state: str | None = None) -> DataFrame:
    """(url, depth, seq, ok): a first-in first-out crawl of at most ``page_limit`` pages.

    Links are followed in the order of pages and, within a page, of ``pos``
    (edges: src, dst, pos).  fetched: (url, ok) says which fetches succeed; a
    failed page is tried ``attempts`` times and counts once.  state: a folder where
    every level is saved; an earlier run with the same root is resumed from it.
    """
    spark = edges.sparkSession
    seen, depth = _resume(spark, state, root)
    if seen is None:
        seen = persist_table(spark.createDataFrame([(root, 0, 0)], "url string, depth int, seq long"), "crawl")
        depth = 0
    ok = fetched if fetched is not None else spark.createDataFrame([], "url string, ok boolean")
    ok = ok.select(F.col("url").alias("_u"), "ok")
    total = seen.count()
    while depth < max_depth and total < page_limit:
        level = seen.filter(F.col("depth") == depth).join(ok, F.col("url") == F.col("_u"), "left").filter(F.coalesce("ok", F.lit(True)))
        first = (
            level.join(edges, level.url == edges.src)
            .groupBy("dst").agg(F.min(F.struct("seq", "pos")).alias("at"))
            .join(seen.select(F.col("url").alias("dst")), "dst", "left_anti")
        )
        # At most page_limit rows are ordered in one place: the crawl's own bound.
        room = first.orderBy("at", "dst").limit(page_limit - total)
        numbered = room.select(F.col("dst").alias("url"), F.lit(depth + 1).alias("depth"), (F.row_number().over(Window.orderBy("at", "dst")) + total - 1).cast("long").alias("seq"))
        new = persist_table(numbered, "crawl-level")
        n = new.count()
        if n == 0:
            break
        seen = seen.unionByName(new)
        depth, total = depth + 1, total + n
        if state:
            seen.withColumn("root", F.lit(root)).write.mode("overwrite").parquet(f"{state}/level={depth}")
    done = seen.join(ok, F.col("url") == F.col("_u"), "left")
    return done.select("url", "depth", "seq", F.coalesce("ok", F.lit(True)).alias("ok"), F.when(F.coalesce("ok", F.lit(True)), 1).otherwise(attempts).alias("attempts"))


def _resume(spark: SparkSession, state: str | None, root: str):
    if not state:
        return None, 0
    try:
        saved = spark.read.parquet(state)
    except Exception as e:  # noqa: BLE001 - a state that is not there yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return None, 0
        raise
    last = saved.agg(F.max("level")).first()[0]
    if saved.filter(F.col("root") != root).limit(1).count():
        raise ValueError("the saved crawl has another root")
    return saved.filter(F.col("level") == last).select("url", "depth", "seq"), int(last)


def best_first(edges: DataFrame, scores: DataFrame, root: str, page_limit: int, ahead: int = 8, streak: int = 3, least: float = 1 / 3) -> list[tuple[str, float]]:
    """URLs in the order of a crawl that always takes the best scored known link, the first found of equals.

    edges: (src, dst).  scores: (url, score); a link without one has 0.  Stops
    after ``streak`` pages in a row below ``least``.  Only the best ``page_limit``
    links can ever be taken, so the driver holds no more of the queue, and of a
    page; links are read for the next ``ahead`` pages of the queue at once.
    """
    rated = lambda df: df.join(scores, "url", "left").fillna({"score": 0.0})
    known: dict[str, list[tuple[float, str]]] = {}

    def read(urls: list[str]) -> None:
        out = edges.filter(F.col("src").isin(urls)).select("src", F.col("dst").alias("url")).distinct()
        best = Window.partitionBy("src").orderBy(F.col("score").desc(), "url")
        rows = rated(out).withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= page_limit)
        known.update({u: [] for u in urls})
        for r in rows.select("src", "score", "url").collect():
            known[r["src"]].append((-r["score"], r["url"]))

    start = rated(edges.sparkSession.createDataFrame([(root,)], "url string")).first()
    queue: list[tuple[float, int, str]] = [(-start["score"], 0, root)]
    seen, visited, bad = {root}, [], 0
    while queue and len(visited) < page_limit:
        loss, _, url = heapq.heappop(queue)
        visited.append((url, -loss))
        bad = 0 if -loss >= least or len(visited) == 1 else bad + 1
        if bad >= streak:
            break
        if url not in known:
            following = (u for _, _, u in heapq.nsmallest(ahead - 1, queue))
            read([url, *(u for u in following if u not in known)])
        for cost, link in sorted(known.pop(url)):
            if link not in seen:
                seen.add(link)
                heapq.heappush(queue, (cost, len(visited), link))
        queue = heapq.nsmallest(page_limit - len(visited), queue)
    return visited


def retry_plan(failures: DataFrame, retry_on: list[str], attempts: int, delay: float, most: float) -> DataFrame:
    """Failures marked again or terminal, with the time of the next try."""
    again = F.col("error_type").isin(retry_on) & (F.col("attempt") + 1 < attempts)
    wait = F.least(F.lit(delay) * F.pow(F.lit(2.0), F.col("attempt")), F.lit(most))
    return failures.withColumn("outcome", F.when(again, "again").otherwise("terminal")).withColumn("ready_at", F.when(again, F.col("failed_at") + wait))


def sitemap_urls(files: DataFrame, roots: list[str], max_depth: int | None = None, limit: int | None = None) -> DataFrame:
    """(url): the pages that sitemaps list, in order, cycles and missing files left out.

    files: (url, xml), the sitemaps that were read.  Indexes are followed to their
    end and all pages returned unless a caller gives ``max_depth`` or ``limit``.
    A file's text is searched once, before its places become rows: behind the
    explode each row would search the whole file again.
    """
    loc = F.regexp_extract_all("xml", F.lit(r"(?s)<(?:[\w-]+:)?loc>\s*(.*?)\s*</(?:[\w-]+:)?loc>"), F.lit(1))
    read = files.select(F.col("url").alias("file"), F.col("xml").rlike(r"<(?:[\w-]+:)?sitemapindex\b").alias("index"), loc.alias("locs"))
    # explode_outer: for explode Spark adds a filter on the size of locs, which is another search.
    places = read.select("file", "index", F.explode_outer("locs").alias("loc")).filter("loc is not null")
    plain = F.replace(F.replace(F.replace(F.col("loc"), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    parsed = persist_table(places.select("file", "index", urls.normalize(plain).alias("loc")), "sitemaps")
    links = parsed.filter("index").select("file", F.col("loc").alias("to"))
    front = files.sparkSession.createDataFrame([(r,) for r in roots], "file string")
    done, depth = front, 0
    while max_depth is None or depth < max_depth:
        new = links.join(front, "file", "left_semi").select(F.col("to").alias("file")).distinct()
        front = persist_table(new.join(done, "file", "left_anti"), "sitemap-front")
        if front.isEmpty():
            break
        done, depth = done.unionByName(front), depth + 1
    out = parsed.filter("not index").join(done, "file", "left_semi").select(F.col("loc").alias("url")).distinct().orderBy("url")
    return out if limit is None else out.limit(limit)


def listed_links(text: Column) -> Column:
    """URLs of the Markdown links of an llms.txt body; none if it is HTML."""
    found = F.regexp_extract_all(text, F.lit(r'\[[^\]]*\]\(\s*<?([^)\s>]+)>?(?:\s+"[^"]*")?\s*\)'), F.lit(1))
    return F.when(F.ltrim(text).startswith("<"), F.array().cast("array<string>")).otherwise(found)


def llms_txt(pages: DataFrame, title: str, summary: str = "") -> DataFrame:
    """One row: an llms.txt of pages (seq, url, title, description, ok), in order; failed ones are left out."""
    line = lambda c: F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    name = F.when(line(F.col("title")) != "", line(F.col("title"))).otherwise(F.col("url"))
    entry = F.concat(F.lit("- ["), F.regexp_replace(name, r"([\[\]])", r"\\$1"), F.lit("]("), F.col("url"), F.lit(")"))
    entry = F.when(line(F.col("description")) != "", F.concat(entry, F.lit(": "), line(F.col("description")))).otherwise(entry)
    body = pages.filter("ok").agg(F.array_sort(F.collect_list(F.struct("seq", entry.alias("entry")))).alias("e"))
    head = [f"# {title}", ""] + ([f"> {summary}", ""] if summary else []) + ["## Pages", ""]
    return body.select(F.concat(F.lit("\n".join(head) + "\n"), F.array_join(F.transform("e", lambda x: x["entry"]), "\n"), F.lit("\n")).alias("llms_txt"))
