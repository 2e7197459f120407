"""Queries over raw pages that stay in native columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import errors, pages, urls
from loomstone.functions.native_text import PAGE_TEXT_SQL
from loomstone.plans.registry import query
from loomstone.runtime import table

T = PAGE_TEXT_SQL


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("page_titles", f"SELECT page_id, {T.title} AS title FROM pages")
def page_titles(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", pages.title(F.col("html")).alias("title"))


@query("page_language", r"SELECT page_id, trim(regexp_extract(html, '(?is)<html[^>]*\blang=\"([^\"]*)\"', 1)) AS language FROM pages")
def page_language(spark, sf_dir):
    lang = F.trim(F.regexp_extract("html", r'(?is)<html[^>]*\blang="([^"]*)"', 1))
    return _pages(spark, sf_dir).select("page_id", lang.alias("language"))


@query("page_plain_text", f"SELECT page_id, sha256(t) AS text_sha256, length(t) AS text_chars, len(string_split(t, chr(10))) AS lines FROM (SELECT page_id, {T.plain} AS t FROM pages)")
def page_plain_text(spark, sf_dir):
    t = _pages(spark, sf_dir).select("page_id", pages.plain_text(F.col("html")).alias("t"))
    return t.select("page_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("bigint").alias("text_chars"), F.size(F.split("t", "\n")).cast("bigint").alias("lines"))


@query("page_needs_javascript", f"SELECT page_id, regexp_matches(html, '(?i)<script\\b') AND length(regexp_replace({T.plain}, '\\s+', '', 'g')) < 250 AS needs_javascript FROM pages")
def page_needs_javascript(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", pages.needs_javascript(F.col("html")).alias("needs_javascript"))


#: What is put before every second page, in turn, so that there are challenges to find.
SPIKES = [
    "<title>Just a moment...</title>", "<title>Access denied</title><p>Unusual traffic from your network</p>", "<title>One more step</title>",
    "<script src='/cdn-cgi/challenge-platform/x.js'></script>", "<p>Please verify that you are a human</p>", "<form action='/errors/validateCaptcha'>",
    "<title>Are you a robot?</title>", "<div class='h-captcha'></div><p>Checking your browser</p>", "<p>Press & hold</p><p>We use cookies</p>",
    "<title>Captcha</title><script src='https://geo.captcha-delivery.com/c.js'></script>", "<p>You've been blocked</p>",
]


def _any_sql(column: str, patterns: list[tuple[str, str]], prefix: str = "") -> str:
    quoted = [(prefix + n).replace("'", "''") for n, _ in patterns]
    tests = [f"CASE WHEN regexp_matches({column}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, (_, p) in zip(quoted, patterns, strict=True)]
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


_SPIKE_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in SPIKES) + "]"
CHALLENGES_SQL = f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html ELSE {_SPIKE_SQL}[(page_id // 2) % {len(SPIKES)} + 1] || substr(html, 1, 1 + 120 * (page_id % 30)) END AS html FROM pages),
t AS (SELECT page_id, html, {T.title} AS title, array_to_string(list_filter(string_split({T.plain}, chr(10)), lambda x: NOT regexp_matches(x, '(?i){pages.COOKIE}')), chr(10)) AS text FROM p),
s AS (SELECT page_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n, {_any_sql("title", pages.CHALLENGE_TITLES)} AS sure, {_any_sql("title", pages.SHORT_TITLES)} AS titles,
  {_any_sql("html", pages.VENDORS, "vendor: ")} AS vendors, {_any_sql("html", pages.WALLS, "vendor: ")} AS walls, {_any_sql("text", pages.PHRASES)} AS phrases FROM t)
SELECT page_id, CAST(n AS INTEGER) AS text_chars, array_to_string(list_concat(sure, CASE WHEN n <= 1500 AND ((len(titles) > 0)::INT + (len(vendors) > 0)::INT + (len(phrases) > 0)::INT >= 2
  OR ((len(phrases) > 0 OR len(walls) > 0) AND n <= 600)) THEN list_concat(list_concat(titles, vendors), list_concat(walls, phrases)) ELSE [] END), ';') AS signals FROM s"""


@query("page_challenges", CHALLENGES_SQL)
def page_challenges(spark, sf_dir):
    """Challenge signals of all pages, every second one cut short behind what a bot wall may show."""
    k = F.floor(F.col("page_id") / 2) % len(SPIKES) + 1
    short = F.substring("html", F.lit(1), (1 + 120 * (F.col("page_id") % 30)).cast("int"))
    spiked = F.concat(F.element_at(F.array(*map(F.lit, SPIKES)), k.cast("int")), short)
    rows = _pages(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(spiked).alias("html"))
    html = F.col("html")
    v = pages.challenge(html, pages.without_cookie_lines(pages.plain_text(html)))
    return rows.select("page_id", v.alias("v")).select("page_id", "v.text_chars", F.array_join("v.signals", ";").alias("signals"))


@query("page_tokens", "SELECT page_id, CASE WHEN length(html) = 0 THEN 0 ELSE greatest(1, length(html) // 4) END AS html_tokens, CAST(octet_length(encode(html)) AS BIGINT) AS html_bytes FROM pages")
def page_tokens(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "page_id", pages.estimate_tokens(F.col("html")).alias("html_tokens"), F.octet_length("html").cast("bigint").alias("html_bytes")
    )


@query("page_token_savings", f"SELECT page_id, CASE WHEN length(html) // 4 = 0 THEN 0.0 ELSE greatest(0.0, 100.0 * (1 - greatest(1, length(t) // 4) / CAST(length(html) // 4 AS DOUBLE))) END AS saved_percent FROM (SELECT page_id, html, {T.plain} AS t FROM pages)")
def page_token_savings(spark, sf_dir):
    raw, kept = pages.estimate_tokens(F.col("html")), pages.estimate_tokens(pages.plain_text(F.col("html")))
    return _pages(spark, sf_dir).select("page_id", F.when(raw == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 * (1 - kept / raw))).alias("saved_percent"))


@query("page_links", r"SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id, href")
def page_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode(pages.anchors(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("page_sorted_links", r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref=\"([^\"]*)\"', 1))), ' ') AS links FROM pages")
def page_sorted_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.array_join(F.array_sort(F.array_distinct(pages.anchors(F.col("html")))), " ").alias("links"))


@query("page_prompt_html", r"""SELECT page_id, sha256(p) AS prompt_sha256, length(p) AS prompt_chars FROM (SELECT page_id, substr(regexp_replace(regexp_replace(
  CASE WHEN strpos(lower(html), '<body') > 0 THEN substr(html, strpos(lower(html), '<body')) ELSE html END,
  '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<svg\b.*?</svg\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<!--.*?-->', '', 'g'), '\s+', ' ', 'g'), 1, 40000) AS p FROM pages)""")
def page_prompt_html(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", pages.prompt_html(F.col("html")).alias("p"))
    return p.select("page_id", F.sha2("p", 256).alias("prompt_sha256"), F.length("p").cast("bigint").alias("prompt_chars"))


@query("page_head_cut", f"SELECT page_id, sha256(substr(t, 1, 500)) AS head_sha256, greatest(length(t) - 500, 0) AS omitted FROM (SELECT page_id, {T.plain} AS t FROM pages)")
def page_head_cut(spark, sf_dir):
    t = _pages(spark, sf_dir).select("page_id", pages.head_cut(pages.plain_text(F.col("html")), 500).alias("h"))
    return t.select("page_id", F.sha2("h.text", 256).alias("head_sha256"), "h.omitted")


@query("page_classes", f"""WITH p AS (SELECT page_id, {T.plain} AS t FROM pages)
SELECT class, count(*) AS n, avg(length(r)) AS mean_chars FROM (SELECT r, CASE WHEN length(r) = 0 THEN 'thin'
 WHEN length(r) < 3000 AND regexp_matches(r, '(?i)just a moment|checking your browser|captcha|access denied|403 forbidden|request blocked|unusual traffic|client challenge') THEN 'junk'
 WHEN length(r) < 300 THEN 'thin' ELSE 'content' END AS class FROM (SELECT trim(regexp_replace(regexp_replace(t, '[#|>\\-*_=\\[\\]()]', ' ', 'g'), '\\s+', ' ', 'g')) AS r FROM p)) GROUP BY class""")
def page_classes(spark, sf_dir):
    r = pages.squeeze(F.regexp_replace(pages.plain_text(F.col("html")), r"[#|>\-*_=\[\]()]", " "))
    rows = _pages(spark, sf_dir).select(r.alias("r"))
    c = pages.classify_result(F.col("r"), F.lit(None).cast("int"), F.lit(False))
    return rows.groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.avg(F.length("r")).alias("mean_chars"))


@query("page_report", f"""SELECT page_id, url_host, title, text_tokens, needs_javascript, CASE WHEN needs_javascript THEN 'partial' ELSE 'complete' END AS coverage
FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS url_host, {T.title} AS title, CASE WHEN length({T.plain}) = 0 THEN 0 ELSE greatest(1, length({T.plain}) // 4) END AS text_tokens,
 regexp_matches(html, '(?i)<script\\b') AND length(regexp_replace({T.plain}, '\\s+', '', 'g')) < 250 AS needs_javascript FROM pages)""")
def page_report(spark, sf_dir):
    """What a reader wants to know of every page: host, title, size, and whether it was read whole."""
    html = F.col("html")
    rows = _pages(spark, sf_dir).select(
        "page_id", urls.host(F.col("url")).alias("url_host"), pages.title(html).alias("title"),
        pages.plain_text(html).alias("text"), pages.needs_javascript(html).alias("needs_javascript"),
    )
    cover = errors.coverage(F.lit(None).cast("string"), F.lit(0), {"javascript_required": F.col("needs_javascript")}, F.lit(1))
    return rows.select("page_id", "url_host", "title", pages.estimate_tokens(F.col("text")).alias("text_tokens"), "needs_javascript", cover["status"].alias("coverage"))


@query("document_hashes", "SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def document_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint"))


@query("document_changes", """WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0),
cur AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents)
SELECT CASE WHEN old.h IS NULL THEN 'new' WHEN old.h <> cur.h THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM cur LEFT JOIN old USING (doc_id) GROUP BY 1""")
def document_changes(spark, sf_dir):
    """Counts of new, changed and unchanged documents against an earlier snapshot (made up from the ids)."""
    from loomstone.operators.warehouse import change_status

    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    now = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return change_status(now, old, "doc_id", "h").groupBy("change").agg(F.count("*").alias("n"))


@query("document_line_stats", r"""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{1,6}\s+'))) AS BIGINT) AS headings,
 CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*\|'))) AS BIGINT) AS table_rows,
 CAST(len(regexp_extract_all(text, '\[[^\]]+\]\([^)]+\)')) AS BIGINT) AS links FROM documents""")
def document_line_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", pages.markdown_counts(F.col("text")).alias("c"))
    return d.select("doc_id", "c.headings", "c.table_rows", "c.links")
