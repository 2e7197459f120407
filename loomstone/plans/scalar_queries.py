"""Queries over small columns and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import scalars as s
from loomstone.functions import urls
from loomstone.operators import guards
from loomstone.operators.evaluation import quality_score
from loomstone.plans.registry import query
from loomstone.runtime import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("numbers_in_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 4 = 3 THEN floor(o_totalprice) ELSE CAST(round(o_totalprice, 2) AS DOUBLE) END AS value FROM orders")
def numbers_in_text(spark, sf_dir):
    """Prices written in four ways, and words without a number, back to numbers."""
    english = F.format_number("o_totalprice", 2)
    german = F.translate(english, ",.", ".,")
    whole = F.format_number(F.floor("o_totalprice"), 0)
    way = F.col("o_orderkey") % 4
    text = F.when(way == 0, F.concat(F.lit("EUR "), german, F.lit(" net"))).when(way == 1, F.concat(F.lit("$"), english)).when(way == 2, F.concat(F.lit("about "), F.replace(english, F.lit(","), F.lit("")), F.lit(".")))
    text = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderstatus")).otherwise(text.otherwise(F.concat(whole, F.lit(" of"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.number(text).alias("value"))


@query("cache_keys", """SELECT page_id, sha256('{"formats":"links,markdown","owner":null,"url":"' || replace(url, '/', '/') || '"}') AS key FROM pages""")
def cache_keys(spark, sf_dir):
    key = s.cache_key(url=F.col("url"), owner=F.lit(None).cast("string"), formats=F.lit("links,markdown"))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("key"))


@query("table_cells", "SELECT p_partkey, replace(p_name || '|' || p_brand, '|', '\\|') AS cell FROM part")
def table_cells(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", s.cell(F.concat("p_name", F.lit("|"), "p_brand")).alias("cell"))


@query("structure_errors", "SELECT doc_id, CAST(CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '|'))) > 0 AND NOT contains(text, '---') THEN 1 ELSE 0 END AS INTEGER) AS errors FROM documents")
def structure_errors(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", s.structure_errors(F.col("text")).alias("errors"))


@query("fenced_turns", "SELECT conv_id, turn, (sum(CAST(turn % 3 = 1 AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn)) % 2 = 1 OR turn % 3 = 1 AS fenced FROM conversations")
def fenced_turns(spark, sf_dir):
    """Parity of fences, with every third turn of a conversation standing for a fence line."""
    c = table(spark, sf_dir, "conversations").withColumn("line", F.when(F.col("turn") % 3 == 1, " ```").otherwise(F.lit("x")))
    return s.in_fence(c, "conv_id", "turn", "line").select("conv_id", "turn", "fenced")


@query("section_extents", "WITH h AS (SELECT user_id, event_id, event_id % 4 + 1 AS level FROM events) SELECT a.event_id, min(b.event_id) AS stop FROM h a LEFT JOIN h b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.level <= a.level GROUP BY a.event_id")
def section_extents(spark, sf_dir):
    """Where each section ends, with events of a user standing for headings of levels 1 to 4."""
    h = _events(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") % 4 + 1).alias("level"))
    return s.section_ends(h, "user_id", "event_id", "level").select("event_id", "stop")


@query("conditional_fetches", "SELECT length(html) <= 3300 AS not_modified, count(*) AS n FROM pages GROUP BY 1")
def conditional_fetches(spark, sf_dir):
    """Tags of pages against those of the same pages cut at 3,300 characters: equal where nothing was cut."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), F.sha2("html", 256).alias("etag"), F.sha2(F.substring("html", 1, 3300), 256).alias("old"))
    return s.not_modified(p.select("url", "etag"), p.select("url", F.col("old").alias("etag"))).groupBy("not_modified").agg(F.count("*").alias("n"))


@query("fetch_fallbacks", """SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'purchase'), max(event_id)) AS event_id, bool_or(event_type = 'purchase') AS ok FROM events WHERE value > 30 GROUP BY user_id""")
def fetch_fallbacks(spark, sf_dir):
    """A user's dearer events as attempts in order, of which purchases succeed."""
    tries = _events(spark, sf_dir).filter("value > 30").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("ok"))
    return s.first_success(tries, "user_id", "event_id", "ok")


@query("run_metrics", "SELECT count(*) FILTER (event_type IN ('view', 'click')) AS visited, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type NOT IN ('view', 'click', 'error')) AS pending, CAST(sum(event_id % 3) AS BIGINT) AS retries, false AS all_failed FROM events")
def run_metrics(spark, sf_dir):
    status = F.when(F.col("event_type").isin("view", "click"), "ok").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return s.run_metrics(_events(spark, sf_dir).select(status.alias("status"), (F.col("event_id") % 3).alias("retries")))


@query("audit_summary", "SELECT count(*) FILTER (event_type <> 'error') AS sent, count(*) FILTER (user_id % 2 = 0) AS third_party, count(*) FILTER (event_type = 'error') AS blocked, CAST(sum(floor(value)) AS BIGINT) AS bytes FROM events")
def audit_summary(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.floor("value").cast("bigint").alias("bytes"), (F.col("user_id") % 2 == 0).alias("third_party"), (F.col("event_type") == "error").alias("blocked"))
    return guards.audit_summary(e)


@query("quality_scores", "SELECT doc_id, greatest(0, 100 - 12 * least(a, 9) - 15 * least(b, 3) - 6 * c - 8 * d) AS score FROM (SELECT doc_id, length(text) - length(replace(text, '!', '')) AS a, length(text) - length(replace(text, '#', '')) AS b, CAST(text LIKE '%@%' AS INTEGER) AS c, CAST(text LIKE '%|%' AS INTEGER) AS d FROM documents)")
def quality_scores(spark, sf_dir):
    """Marks found in each document stand for missing and leaked signals."""
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    has = lambda c: F.contains("text", F.lit(c)).cast("int")
    score = quality_score(F.least(count("!"), F.lit(9)), F.least(count("#"), F.lit(3)), has("@"), has("|"))
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@query("secret_parameters", r"""SELECT name, regexp_matches(replace(replace(replace(lower(name), '_', ''), '-', ''), '.', ''), '(token|key|apikey|auth|sig|signature|session|sessionid|sid|secret|password|passwd|pwd|jwt|code|credential|credentials)$') AS secret
FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_.-]+[ ]?[:=]')) AS raw FROM documents), LATERAL (SELECT regexp_replace(raw, '[ ]?[:=]$', '') AS name) GROUP BY ALL""")
def secret_parameters(spark, sf_dir):
    """All names that stand before a colon or an equals sign in the documents."""
    raw = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_.-]+[ ]?[:=]"), F.lit(0))).alias("raw"))
    names = raw.select(F.regexp_replace("raw", "[ ]?[:=]$", "").alias("name")).distinct()
    return names.select("name", urls.is_secret(F.col("name")).alias("secret"))


@query("guarded_urls", "SELECT l_orderkey, l_linenumber, l_returnflag <> 'R' AND floor(l_extendedprice) BETWEEN 1 AND 65535 AS ok FROM lineitem")
def guarded_urls(spark, sf_dir):
    """Lines as URLs: the price is the port, returned ones carry user information."""
    port = F.floor("l_extendedprice").cast("string")
    url = F.concat(F.when(F.col("l_returnflag") == "R", "http://user:pw@h.example.com:").otherwise("http://h.example.com:"), port, F.lit("/x"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", guards.url_shape_ok(url).alias("ok"))


@query("chunk_statistics", "SELECT doc_id, CAST(n AS BIGINT) AS total, CAST(least(n, 4) AS BIGINT) AS used, CAST(n - least(n, 4) AS BIGINT) AS omitted FROM (SELECT doc_id, len(list_filter(list_transform(range(CAST(greatest(1, ceil(length(text) / 400.0)) AS BIGINT)), lambda i: trim(substr(text, i * 400 + 1, 400), ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) AS n FROM documents)")
def chunk_statistics(spark, sf_dir):
    """Chunks of 400 characters: all, those within a limit of four, and those left out."""
    from loomstone.functions.retrieval import fixed_chunks

    n = F.size(fixed_chunks(F.col("text"), 400, 1 << 30))
    d = table(spark, sf_dir, "documents").select("doc_id", n.cast("bigint").alias("total"))
    return d.select("doc_id", "total", F.least("total", F.lit(4)).alias("used"), F.greatest(F.col("total") - 4, F.lit(0)).alias("omitted"))
