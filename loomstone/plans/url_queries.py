"""Queries over page URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import urls
from loomstone.plans.registry import query
from loomstone.runtime import table

def _u():
    return F.col("url")


HOST = "rtrim(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '.')"
PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
KEPT = f"""array_to_string(list_sort(list_filter(string_split({QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')
 AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'dclid', 'msclkid', 'mc_cid', 'mc_eid'))), '&')"""
NORMAL = f"""regexp_extract(url, '^(https?)', 1) || '://' || {HOST} || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN {KEPT} = '' THEN '' ELSE '?' || {KEPT} END"""


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("url_normalized", f"SELECT page_id, {NORMAL} AS url FROM pages")
def url_normalized(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.normalize(_u()).alias("url"))


@query("url_canonical_groups", f"SELECT {NORMAL} AS url, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1 HAVING count(*) > 1")
def url_canonical_groups(spark, sf_dir):
    """Canonical URLs that several pages share."""
    return _pages(spark, sf_dir).groupBy(urls.normalize(_u()).alias("url")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).filter("n > 1")


@query("url_origins", f"SELECT regexp_extract(url, '^(https?)', 1) AS scheme, {HOST} AS host, CASE WHEN url LIKE 'https%' THEN 443 ELSE 80 END AS port, count(*) AS n FROM pages GROUP BY ALL")
def url_origins(spark, sf_dir):
    return _pages(spark, sf_dir).select(urls.origin(_u()).alias("o")).groupBy("o.scheme", "o.host", "o.port").agg(F.count("*").alias("n"))


@query("url_same_site", f"SELECT page_id, {HOST} = 'example.com' OR {HOST} LIKE '%.example.com' AS same_site FROM pages")
def url_same_site(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.same_site(_u(), F.lit("https://www.example.com/")).alias("same_site"))


@query("url_filtered", r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '/en/|/fr/') AND NOT (regexp_matches(url, 'spam|pills') OR regexp_matches(url, '\.html$'))")
def url_filtered(spark, sf_dir):
    """Include and exclude patterns; the broken one finds nothing."""
    return _pages(spark, sf_dir).filter(urls.allowed(_u(), ["/en/|/fr/"], ["spam|pills", r"\.html$", "(broken"])).select("page_id", "url")


@query("url_redacted", r"SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') || '?id=1&access_token=REDACTED&Api-Key=REDACTED&page=2#x' AS url FROM pages")
def url_redacted(spark, sf_dir):
    made = F.concat(F.substring_index(F.substring_index("url", "#", 1), "?", 1), F.lit("?id=1&access_token=abc&Api-Key=k&page=2#x"))
    return _pages(spark, sf_dir).select("page_id", urls.redact_url(made).alias("url"))


@query("url_credentials", "SELECT page_id, 'proxy ' || regexp_replace(url, '^(https?://)', '\\1***@') || ' failed' AS message FROM pages")
def url_credentials(spark, sf_dir):
    text = F.concat(F.lit("proxy "), F.regexp_replace("url", "^(https?://)", "$1user:secret@"), F.lit(" failed"))
    return _pages(spark, sf_dir).select("page_id", urls.redact_credentials(text).alias("message"))


@query("url_query_keys", f"SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split({QUERY}, '&'), lambda p: p <> ''), lambda p: split_part(p, '=', 1)))), ',') AS keys FROM pages")
def url_query_keys(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.array_join(urls.query_keys(urls.part(_u(), 5)), ",").alias("keys"))


@query("url_words", rf"SELECT page_id, trim(regexp_replace({PATH} || ' ' || {QUERY}, '[/_.?&=+\-]+', ' ', 'g')) AS words FROM pages")
def url_words(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.url_words(_u()).alias("words"))


@query("url_allowlist", f"SELECT page_id FROM pages WHERE {HOST} = 'ththed.example.org' OR {HOST} LIKE '%.example.net'")
def url_allowlist(spark, sf_dir):
    return _pages(spark, sf_dir).filter(urls.host_matches(urls.host(_u()), ["ththed.example.org", "*.example.net"])).select("page_id")


@query("url_hosts_ranked", f"SELECT host, n, CAST(rank() OVER (ORDER BY n DESC, host) AS INTEGER) AS place FROM (SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1)")
def url_hosts_ranked(spark, sf_dir):
    from pyspark.sql import Window

    n = _pages(spark, sf_dir).groupBy(urls.host(_u()).alias("host")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.col("n").desc(), "host")))


@query("url_inventory", f"""SELECT DISTINCT u AS url FROM (SELECT {NORMAL} AS u FROM pages UNION ALL
 SELECT regexp_extract(url, '^(https?)', 1) || '://' || {HOST} || h FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref="(/[^"]*)"', 1)) AS h FROM pages) WHERE NOT contains(h, '?') AND NOT contains(h, '#')) ORDER BY url LIMIT 500""")
def url_inventory(spark, sf_dir):
    """The first 500 canonical URLs of a site map: page URLs and root-relative links, distinct and sorted."""
    p = _pages(spark, sf_dir)
    own = p.select(urls.normalize(_u()).alias("url"))
    links = p.select("url", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*?\bhref="(/[^"]*)"'), F.lit(1))).alias("h"))
    links = links.filter(~F.col("h").contains("?") & ~F.col("h").contains("#")).select(F.concat(urls.scheme(_u()), F.lit("://"), urls.host(_u()), F.col("h")).alias("url"))
    return own.unionByName(links).distinct().orderBy("url").limit(500)
