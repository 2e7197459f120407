"""Rows that the given tables lack: Spark and DuckDB still agree."""

import duckdb
from loomstone.plans import queries as q


def both(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    cur = con.execute(q.ORACLES[name])
    names = [d[0] for d in cur.description]
    return sorted((tuple(r) for r in q.QUERIES[name](spark, str(folder)).select(names).collect()), key=repr), sorted(cur.fetchall(), key=repr)


def test_fixed_chunks_of_blank_texts(spark, tmp_path):
    texts = [None, "", " \n\t\r ", "x", "\x0b", "\x0b x \x0c", " " * 400 + "x", "a" * 399 + " " * 402 + "b", ("x" * 399 + "\x0c") * 3, "x" * 400, "y" * 5000, "👩‍👩‍👧" * 300]
    mine, theirs = both(spark, tmp_path, "doc_fixed_chunks", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert mine == theirs
    assert mine[:3] == [(0, 0, None), (1, 0, None), (10, 8, 3200)]


def test_titles_with_cut_references(spark, tmp_path):
    html = [
        None, "", "<p>no title", '<html lang="en"><title></title>', '<html lang="en"><title>a &amp;&amp;&amp b&amp</title>', "<title>&quot &quo &am &lt &copy &middot;</title>",
        '<html lang=" de "><TITLE class=x>\n A\x0b \r\n\r\n B  </TITLE\n>', "<title>a &gt; &eacute; &#39; &amp;lt; &lt;b&gt;</title>", "x\ny\n<title>one <b>1</b></title>\n<title>two</title>",
        "<title>unclosed &amp", '<html class="x" lang="fr">\n\n<title>  wide　 </title>', "<title/>a</title>", "<title>a <!-- b</title> c --></title>",
    ]
    mine, theirs = both(spark, tmp_path, "parsed_titles", "pages", [(i, "http://h.example/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    assert mine == theirs
    assert (4, "en", "a &&&amp b&amp") in mine
