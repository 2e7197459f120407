"""Queries over link graphs, documents, evaluations and streams.

No anchor of the pages table leads to another page of it, so edges are derived:
within a host, pages in id order form a binary tree (page i links to 2i + 1 and
2i + 2).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.functions import pages as P
from loomstone.functions import urls
from loomstone.operators import crawl, evaluation
from loomstone.plans.registry import query
from loomstone.plans.url_queries import HOST, NORMAL
from loomstone.runtime import persist_table, table
from loomstone.sources.readers import convert_files, document_kind
from loomstone.streaming import usage

RANKED = f"r AS (SELECT page_id, {HOST} AS host, CAST(row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS BIGINT) AS i FROM pages)"


def _ranked(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return p.withColumn("i", F.row_number().over(Window.partitionBy("host").orderBy("page_id")) - 1)


def _edges(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    child = r.select("host", F.col("page_id").alias("child"), F.floor((F.col("i") - 1) / 2).cast("int").alias("i"), F.pmod(F.col("i") - 1, F.lit(2)).alias("pos")).filter("i >= 0")
    return r.join(child, ["host", "i"]).select(name("page_id").alias("src"), name("child").alias("dst"), "pos")


@query("crawl_edges", f"WITH {RANKED} SELECT 'p' || a.page_id AS src, 'p' || b.page_id AS dst FROM r a JOIN r b ON a.host = b.host AND b.i > 0 AND a.i = (b.i - 1) // 2")
def crawl_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "dst")


@query("crawl_depths", f"""WITH RECURSIVE {RANKED}, e AS (SELECT 'p' || a.page_id AS src, 'p' || b.page_id AS dst FROM r a JOIN r b ON a.host = b.host AND b.i > 0 AND a.i = (b.i - 1) // 2),
w AS (SELECT 'p' || page_id AS root, 'p' || page_id AS url, 0 AS depth FROM r WHERE i = 0 UNION SELECT w.root, e.dst, w.depth + 1 FROM w JOIN e ON w.url = e.src WHERE w.depth < 3)
SELECT root, url, min(depth) AS depth FROM w GROUP BY root, url""")
def crawl_depths(spark, sf_dir):
    """What each host's first page reaches within three links."""
    roots = _ranked(spark, sf_dir).filter("i = 0").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("root"))
    return crawl.breadth_first(_edges(spark, sf_dir).select("src", "dst"), roots, 3)


@query("crawl_limited", f"WITH {RANKED} SELECT 'p' || page_id AS url, i AS seq FROM r WHERE host = (SELECT host FROM r GROUP BY host ORDER BY count(*) DESC, host LIMIT 1) AND i < 12")
def crawl_limited(spark, sf_dir):
    """A crawl of at most 12 pages of the largest host."""
    host = _ranked(spark, sf_dir).groupBy("host").count().orderBy(F.col("count").desc(), "host").first()["host"]
    root = _ranked(spark, sf_dir).filter((F.col("host") == host) & (F.col("i") == 0)).first()["page_id"]
    return crawl.limited_crawl(_edges(spark, sf_dir), f"p{root}", 12, 10).select("url", "seq")


@query("crawl_best_first")
def crawl_best_first(spark, sf_dir):
    """The order of a crawl that takes well scored pages first."""
    r = _ranked(spark, sf_dir)
    scores = r.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("url"), (F.pmod(F.xxhash64("page_id"), F.lit(100)) / 100.0).alias("score"))
    host = r.groupBy("host").count().orderBy(F.col("count").desc(), "host").first()["host"]
    root = r.filter((F.col("host") == host) & (F.col("i") == 0)).first()["page_id"]
    order = crawl.best_first(_edges(spark, sf_dir).select("src", "dst"), scores, f"p{root}", 10)
    return spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(order)], "place int, url string, score double")


@query("sitemap_pages", f"SELECT DISTINCT {NORMAL} AS url FROM pages ORDER BY url")
def sitemap_pages(spark, sf_dir):
    """Pages of a sitemap index: each language has a sitemap for 1,000 ids, an index lists those of 100,000 ids, the first index lists these and itself."""
    site = lambda *name: F.concat(F.lit("https://x.example/"), *name, F.lit(".xml"))
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    listed = lambda tag, c: F.array_join(F.collect_list(F.concat(F.lit(f"<{tag}><loc> "), text(c), F.lit(f" </loc></{tag}>"))), "")
    index = lambda entries: F.concat(F.lit("<sitemapindex>"), entries, F.lit("</sitemapindex>")).alias("xml")

    # A page without HTML has the empty language; names are encoded, so they can be paths.
    lang = F.url_encode(F.coalesce(F.regexp_extract("html", '<html lang="([^"]*)"', 1), F.lit("")))
    p = table(spark, sf_dir, "pages").select("url", lang.alias("lang"), F.coalesce(F.floor(F.col("page_id") / 1000), F.lit(0)).alias("part"))
    maps = p.groupBy("lang", "part").agg(F.concat(F.lit("<urlset>"), listed("url", F.col("url")), F.lit("</urlset>")).alias("xml"))
    upper = site(F.lit("index-"), F.floor(F.col("part") / 100).cast("string"))
    maps = persist_table(maps.select(site(F.lit("map-"), "lang", F.lit("-"), F.col("part").cast("string")).alias("url"), "xml", upper.alias("upper")), "maps")
    parts = maps.groupBy("upper").agg(index(listed("sitemap", F.col("url")))).withColumnRenamed("upper", "url")
    first = "https://x.example/index.xml"
    names = maps.select(F.col("upper").alias("url")).distinct().unionByName(spark.createDataFrame([(first,)], "url string"))
    root = names.agg(index(listed("sitemap", F.col("url")))).select(F.lit(first).alias("url"), "xml")
    return crawl.sitemap_urls(root.unionByName(parts).unionByName(maps.select("url", "xml")), [first])


@query("llms_txt", r"""SELECT '# Site' || chr(10) || chr(10) || '> All of it' || chr(10) || chr(10) || '## Pages' || chr(10) || chr(10) || string_agg('- [' || replace(replace(t, '[', '\['), ']', '\]') || '](' || url || ')', chr(10) ORDER BY page_id) || chr(10) AS llms_txt
 FROM (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '\s+', ' ', 'g')) AS t FROM pages WHERE page_id % 7 <> 0)""")
def llms_txt(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url", P.title(F.col("html")).alias("title"), F.lit(None).cast("string").alias("description"), (F.col("page_id") % 7 != 0).alias("ok"))
    return crawl.llms_txt(p, "Site", "All of it")


@query("document_kinds", """SELECT page_id, CASE WHEN length(html) % 3 = 1 THEN 'pdf' WHEN length(html) % 3 = 2 AND url LIKE '%.html' AND page_id % 5 > 0 THEN ['pdf', 'docx', 'xlsx', 'pptx'][page_id % 5] END AS kind
FROM (SELECT page_id, html, regexp_extract(url, '^[^?#]*', 0) AS url FROM pages)""")
def document_kinds(spark, sf_dir):
    """Pages with other suffixes, and content types by their length: HTML, PDF, or a generic one."""
    suffix = F.element_at(F.array(*map(F.lit, [".txt", ".pdf", ".docx", ".XLSX", ".pptx"])), (F.col("page_id") % 5 + 1).cast("int"))
    n = F.length("html") % 3
    kind = F.when(n == 0, "text/html").when(n == 1, "application/pdf").otherwise(F.when(F.col("page_id") % 2 == 0, "application/octet-stream").otherwise(""))
    url = F.replace("url", F.lit(".html"), suffix)
    return table(spark, sf_dir, "pages").select("page_id", document_kind(kind, url).alias("kind"))


@query("csv_document", "SELECT '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation")
def csv_document(spark, sf_dir):
    """The nation table as a CSV file, read back as a Markdown table."""
    n = table(spark, sf_dir, "nation")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat_ws(";", F.col("n_nationkey").cast("string"), "n_name").alias("x")))), lambda r: r["x"]), "\n")
    file = n.agg(F.concat(F.lit("n_nationkey;n_name\n"), lines).alias("c")).select(F.lit("nation.csv").alias("path"), F.col("c").cast("binary").alias("content"))
    return convert_files(file).select("markdown")


@query("html_documents")
def html_documents(spark, sf_dir):
    """Pages as HTML files, read as documents."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return convert_files(p).select("path", "length", F.length("markdown").alias("chars"), "error")


@query("page_diffs")
def page_diffs(spark, sf_dir):
    """Line changes of documents against an edited copy."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\nadded line"))).otherwise(F.col("text")).alias("new"))
    return evaluation.diffs(d, "doc_id").select("doc_id", "added", "removed")


_TOOLS = "t AS (SELECT page_id AS page, tool, CASE tool WHEN 'a' THEN page_id % 3 <> 0 WHEN 'b' THEN page_id % 4 <> 0 ELSE page_id % 5 <> 1 END AS ok FROM pages, (VALUES ('a'), ('b'), ('c')) v(tool))"


def _tools(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.explode(F.array(*map(F.lit, "abc"))).alias("tool"))
    return p.withColumn("ok", F.when(F.col("tool") == "a", F.col("page") % 3 != 0).when(F.col("tool") == "b", F.col("page") % 4 != 0).otherwise(F.col("page") % 5 != 1))


@query("tool_pairs", f"WITH {_TOOLS} SELECT x.tool AS a, y.tool AS b, count(*) FILTER (x.ok AND NOT y.ok) AS a_only, count(*) FILTER (y.ok AND NOT x.ok) AS b_only FROM t x JOIN t y ON x.page = y.page AND x.tool < y.tool GROUP BY ALL")
def tool_pairs(spark, sf_dir):
    return evaluation.paired_counts(_tools(spark, sf_dir)).drop("p")


@query("tool_summary", f"WITH {_TOOLS} SELECT tool, count(*) AS pages, count(*) FILTER (ok) AS read, avg(CAST(ok AS INTEGER)) AS rate FROM t GROUP BY tool")
def tool_summary(spark, sf_dir):
    t = _tools(spark, sf_dir)
    return t.groupBy("tool").agg(F.count("*").alias("pages"), F.count_if("ok").alias("read"), F.avg(F.col("ok").cast("int")).alias("rate"))


@query("tool_consensus")
def tool_consensus(spark, sf_dir):
    """Consensus recall of three made-up tools: all of a page's text, its first half, and every second line."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), P.plain_text(F.col("html")).alias("t"))
    half = F.substring("t", F.lit(1), F.floor(F.length("t") / 2).cast("int"))
    lines = F.array_join(F.filter(F.split("t", "\n"), lambda x, i: i % 2 == 0), "\n")
    made = F.array(*(F.struct(F.lit(n).alias("tool"), c.alias("text")) for n, c in (("all", F.col("t")), ("half", half), ("lines", lines))))
    return evaluation.consensus(p.select("page", F.explode(made).alias("m")).select("m.tool", "page", "m.text"))


@query("eligible_sites", f"""WITH s AS (SELECT page_id, {HOST} AS domain, regexp_extract(html, '<html lang="([^"]*)"', 1) AS kind, url, length(html) AS chars FROM pages),
a AS (SELECT *, row_number() OVER (PARTITION BY domain, chars >= 1500 ORDER BY url, page_id) AS d FROM s), b AS (SELECT *, chars >= 1500 AND d <= 3 AS fit FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY kind, fit ORDER BY url, page_id) AS k FROM b)
SELECT CASE WHEN chars < 1500 THEN 'thin' WHEN NOT fit THEN 'domain_full' WHEN k > 6 THEN 'kind_full' ELSE 'ok' END AS reason, count(*) AS n FROM c GROUP BY 1""")
def eligible_sites(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    s = p.select(urls.host(F.col("url")).alias("domain"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("kind"), "url", F.length("html").alias("chars"))
    return evaluation.eligible(s).groupBy("reason").agg(F.count("*").alias("n"))


@query("stratified_sample", "SELECT lang, CAST(least(count(*), CASE lang WHEN 'en' THEN 40 WHEN 'fr' THEN 40 WHEN 'de' THEN 20 ELSE 0 END) AS BIGINT) AS n FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY lang")
def stratified_sample(spark, sf_dir):
    """100 documents, 40 English, 40 French, 20 German: a sampling operator's counts."""
    s = evaluation.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 0.4, "fr": 0.4, "de": 0.2}, 100, "doc_id")
    return s.groupBy("lang").agg(F.count("*").alias("n"))


@query("stream_rollup", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_rollup(spark, sf_dir):
    """Daily counts and sums, computed as a stream that runs over all events there are."""
    out = usage.drain(usage.rollup(usage.read_events(spark, sf_dir)), "complete")
    return out.select(F.unix_seconds("window.start").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stream_rate_limit")
def stream_rate_limit(spark, sf_dir):
    """Requests that a limit of three an hour lets pass, by a stateful stream."""
    out = usage.drain(usage.admitted(usage.read_events(spark, sf_dir), 3, 3600), "append")
    return out.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if("admitted").alias("admitted"))
