"""Sitemaps: files of bounded size, nothing left out."""

from loomstone.operators import crawl
from loomstone.plans import queries as q
from pyspark.sql import functions as F


def test_pages_go_to_many_small_sitemaps(spark, tmp_path, monkeypatch):
    n = 2500
    html = F.when(F.col("id") == 7, F.lit(None)).when(F.col("id") == 8, F.lit('<html lang="a&b </loc>#?">')).otherwise(F.lit('<html lang="en">'))
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.example/p"), "id").alias("url"), html.alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    seen, read = [], crawl.sitemap_urls
    monkeypatch.setattr(crawl, "sitemap_urls", lambda files, *a: (seen.append(files), read(files, *a))[1])
    got = [r["url"] for r in q.QUERIES["sitemap_pages"](spark, str(tmp_path)).collect()]
    assert got == sorted(f"https://h.example/p{i}" for i in range(n))
    sizes = [r[0] for r in seen[0].select(F.size(F.split("xml", "<loc>")) - 1).collect()]
    assert max(sizes) == 1000


def test_all_pages_of_deep_and_large_indexes(spark):
    """101,000 pages behind seven indexes, one of which lists the first again."""
    name = lambda i: f"https://h.example/i{i}.xml"
    index = lambda *to: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in to) + "</sitemapindex>"
    maps = [f"https://h.example/m{i}.xml" for i in range(101)]
    chain = [(name(i), index(name(i + 1))) for i in range(6)] + [(name(6), index(name(0), "https://h.example/missing.xml", *maps))]
    urls = F.array_join(F.transform(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999), lambda i: F.concat(F.lit("<url><loc>https://h.example/p"), i, F.lit("</loc></url>"))), "")
    pages = spark.range(101).select(F.concat(F.lit("https://h.example/m"), "id", F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), urls, F.lit("</urlset>")).alias("xml"))
    files = spark.createDataFrame(chain, "url string, xml string").unionByName(pages)
    assert crawl.sitemap_urls(files, [name(0)]).count() == 101_000
    assert crawl.sitemap_urls(files, [name(0)], max_depth=6).count() == 0
    assert [r["url"] for r in crawl.sitemap_urls(files, [name(0)], limit=2).collect()] == ["https://h.example/p0", "https://h.example/p1"]
    assert "limit" not in q.ORACLES["sitemap_pages"].lower()
