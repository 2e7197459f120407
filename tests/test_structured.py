import io
import zipfile

import pytest
from loomstone.functions import css, jsons
from loomstone.functions import retrieval as r
from loomstone.functions.html_tree import Tree
from loomstone.operators import crawl, evaluation
from loomstone.operators import warehouse as w
from loomstone.sources import readers
from loomstone.streaming import usage
from pyspark.sql import functions as F

SHOP = """<div class="item first" data-sku="A1"><h2>Lamp</h2><b class=price>1.234,50 €</b><a href="/lamp">x</a><i>red</i><i>blue</i></div>
<div class="item" data-sku="B2"><h2>Desk</h2><b class=price>99</b><p>code: ZX-9</p></div><ul><li>1<li>2<li>3</ul>"""
SCHEMA = {
    "baseSelector": "div.item",
    "fields": [
        {"name": "title", "selector": "h2", "transform": "upper"},
        {"name": "sku", "type": "attribute", "attribute": "data-sku"},
        {"name": "price", "selector": ".price", "transform": "number"},
        {"name": "url", "selector": "a[href]", "type": "attribute", "attribute": "href", "transform": "url"},
        {"name": "colours", "selector": "i", "multiple": True},
        {"name": "code", "type": "regex", "pattern": r"code: (\S+)"},
        {"name": "stock", "selector": ".none", "default": "unknown"},
        {"name": "head", "type": "nested", "selector": "h2", "fields": [{"name": "t"}]},
    ],
}


@pytest.mark.parametrize(
    ("selector", "n"),
    [("div", 2), ("div > h2", 2), ("div.first h2 + b", 1), ("h2 ~ i", 2), ("li:nth-child(2)", 1), ("li:last-child, h2", 3), ("i:nth-of-type(1)", 1), ("[data-sku^=B]", 1), ("[class~=first]", 1), ("#no", 0), ("*", 14)],
)
def test_selectors(selector, n):
    assert len(css.select(Tree(SHOP), selector)) == n


@pytest.mark.parametrize("bad", ["", "a >", "> a", "a:hover", "a:nth-child", "a[", "a,,b"])
def test_bad_selectors(bad):
    with pytest.raises(ValueError):
        css.compile_selector(bad)


def test_extract(spark):
    got = css.extract(SHOP, css.check_schema(SCHEMA), "https://e.com/")
    assert got[0] == {"title": "LAMP", "sku": "A1", "price": 1234.5, "url": "https://e.com/lamp", "colours": ["red", "blue"], "stock": "unknown", "head": {"t": "Lamp"}}
    assert got[1]["code"] == "ZX-9"
    df = spark.createDataFrame([(7, "https://e.com/", SHOP), (8, None, None)], "page_id int, url string, html string")
    rows = css.extract_records(df, SCHEMA).orderBy("idx").collect()
    assert [(x["page_id"], x["idx"], x["price"], x["colours"]) for x in rows] == [(7, 0, 1234.5, ["red", "blue"]), (7, 1, 99.0, None)]
    slow = {"fields": [{"name": "x", "type": "regex", "pattern": "(a+)+$"}]}
    assert css.extract("<p>" + "a" * 3000 + "b", slow) == [{}]
    for broken in ({"fields": []}, {"fields": [{"name": "a"}, {"name": "a"}]}, {"fields": [{"name": "a", "type": "odd"}]}):
        with pytest.raises(ValueError):
            css.check_schema(broken)


@pytest.mark.parametrize(("text", "want"), [("1,234.56 USD", 1234.56), ("1.234,56", 1234.56), ("1,234", 1234), ("3,5", 3.5), ("1.2.3", 123), ("-7 x", -7), ("none", None)])
def test_numbers(text, want):
    assert css.number(text) == want


def test_json():
    assert jsons.shape({"a": [1, None, {"b": True}], "c": "x", "d": []}) == {"a": ["number"], "c": "string", "d": []}
    assert jsons.shape([{"a": None}, {"a": 1, "b": "x"}]) == [{"a": "number", "b": "string"}]
    s = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"$ref": "#/defs/n"}, "minItems": 1}}, "additionalProperties": False, "defs": {"n": {"type": "integer", "maximum": 5}}}
    assert jsons.violation({"a": [1, 2]}, s) is None
    assert jsons.violation({"a": [1, 9]}, s) == "$.a[1]: above 5" and jsons.violation({}, s) == "$.a: missing"
    assert jsons.violation({"a": [True]}, s) and jsons.violation({"a": []}, s) and jsons.violation({"a": [1], "b": 1}, s) == "$.b: not allowed"
    assert jsons.find_json('Sure:\n{"a": 1} ok') == {"a": 1} and jsons.find_json("```json\n[1]\n```") == [1]
    with pytest.raises(ValueError):
        jsons.find_json("no")
    assert jsons.empty_answer(" ") and not jsons.empty_answer(0)


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://w"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DOCX = archive({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc/></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = archive({
    "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>na</t><t>me</t></si></sst>", "xl/worksheets/s.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x|y</t></is></c></row><row><c r="B2" t="b"><v>1</v></c><c r="C2"><v>2.5</v></c></row></sheetData></worksheet>',
})
PPTX = archive({"ppt/slides/slide10.xml": '<p:s xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Ten</a:t></a:r></a:p></p:s>', "ppt/slides/slide2.xml": '<p:s xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Two</a:t></a:r></a:p><a:p><a:r><a:t>point</a:t></a:r></a:p></p:s>'})
FILES = {
    "a.docx": (DOCX, "## Head\n\n- item\n\n| A | column_2 |\n| --- | --- |\n| 1 |  |"),
    "a.xlsx": (XLSX, "## S\n\n| name | column_2 | x\\|y |\n| --- | --- | --- |\n|  | TRUE | 2.5 |"),
    "a.pptx": (PPTX, "## Slide 1: Two\n\n- point\n\n## Slide 2: Ten"),
    "a.csv": (b"\xef\xbb\xbfa;b\n\"x\ny\";1|2\n;\n3", "| a | b |\n| --- | --- |\n| x y | 1\\|2 |\n| 3 |  |"),
    "a.json": (b'{"a":[1]}', '```json\n{\n  "a": [\n    1\n  ]\n}\n```'),
    "a.xml": (b"<urlset><url><loc> http://a/?x&amp;y </loc></url></urlset>", "- http://a/?x&y"),
    "b.xml": (b"<a/>", "```xml\n<a/>\n```"),
    "a.txt": ("  caf\xe9 ".encode("latin-1"), "café"),
    "a.html": (b"<h1>x</h1>", "# x"),
    "bad.docx": (b"no zip", None),
    "doctype.docx": (archive({"word/document.xml": "<!DOCTYPE x><a/>"}), None),
    "a.pdf": (b"%PDF", None),
}


def test_readers(spark, tmp_path):
    for name, (data, _) in FILES.items():
        (tmp_path / name).write_bytes(data)
    rows = {x["path"].rsplit("/", 1)[1]: x for x in readers.read_files(spark, f"file://{tmp_path}").collect()}
    for name, (_, want) in FILES.items():
        assert rows[name]["markdown"] == want, name
        assert (rows[name]["error"] is None) == (want is not None)
    assert rows["a.csv"]["meta"]["row_count"] == "2"
    (tmp_path / "list.lst").write_text("http://a # one\n\n# two\n  http://b  \n")
    assert [x["url"] for x in readers.url_list(spark, f"file://{tmp_path}/list.lst").collect()] == ["http://a", "http://b"]


def test_bytes():
    import gzip
    import zlib

    assert readers.inflate(gzip.compress(b"a") + gzip.compress(b"b"), "gzip") == b"ab"
    assert readers.inflate(zlib.compress(b"x"), "deflate") == readers.inflate(zlib.compress(b"x")[2:-4], "deflate") == b"x"
    with pytest.raises(ValueError):
        readers.inflate(gzip.compress(b"a" * 100), "gzip", 50)
    assert readers.decode("é".encode("utf-16")) == "é" and readers.decode(b"\x93q", "latin1") == "“q"
    assert readers.decode('<meta charset="cp1251">ж'.encode("cp1251")).endswith("ж")
    assert readers.column_index("AB12") == 27


def test_retrieval(spark):
    rows = [(1, i, t) for i, t in enumerate(["Cuál es la política?", "the policy politica", "nothing", ""])]
    df = spark.createDataFrame(rows, "doc_id int, idx int, text string")
    got = {x["idx"]: x["score"] for x in r.bm25(df, "política de la POLICY").collect()}
    assert got[1] > got[0] > 0 == got[2] == got[3]
    assert [x["idx"] for x in r.top_passages(r.bm25(df, "policy"), 1).collect()] == [1]
    assert {x["score"] for x in r.bm25(df, "the of").collect()} == {0.0}


EDGES = [("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0), ("d", "e", 1), ("c", "f", 1)]


def test_crawls(spark, tmp_path):
    e = spark.createDataFrame(EDGES, "src string, dst string, pos int")
    roots = spark.createDataFrame([("a",)], "root string")
    got = {x["url"]: x["depth"] for x in crawl.breadth_first(e.select("src", "dst"), roots, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "f": 2}
    full = [x["url"] for x in crawl.limited_crawl(e, "a", 99, 9).orderBy("seq").collect()]
    assert full == ["a", "b", "c", "d", "f", "e"]
    state = f"file://{tmp_path}/state"
    assert crawl.limited_crawl(e, "a", 99, 1, state=state).count() == 3
    assert [x["url"] for x in crawl.limited_crawl(e, "a", 5, 9, state=state).orderBy("seq").collect()] == full[:5]
    with pytest.raises(ValueError):
        crawl.limited_crawl(e, "b", 5, 9, state=state)
    failed = spark.createDataFrame([("b", False), ("c", False)], "url string, ok boolean")
    assert [x["url"] for x in crawl.limited_crawl(e, "a", 9, 9, failed).orderBy("seq").collect()] == ["a", "b", "c"]
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.9), ("f", 0.8), ("d", 0.0)], "url string, score double")
    assert [u for u, _ in crawl.best_first(e.select("src", "dst"), scores, "a", 4, ahead=2)] == ["a", "c", "f", "b"]
    assert crawl.best_first(e.select("src", "dst"), scores, "b", 9, streak=2)[-1][0] in ("a", "e")
    body = spark.createDataFrame([("- [a](http://a \"t\") [b](<http://b>)",), ("<html>[x](http://x)",)], "t string")
    assert [x[0] for x in body.select(crawl.listed_links(F.col("t"))).collect()] == [["http://a", "http://b"], []]


def test_evaluation(spark):
    from math import comb

    for a, b in [(0, 0), (5, 5), (0, 6), (48, 18), (3, 900), (700, 600)]:
        want = min(1.0, sum(comb(a + b, i) for i in range(min(a, b) + 1)) * 2 / 2 ** (a + b))
        got = spark.range(1).select(evaluation.mcnemar_p(F.lit(a), F.lit(b))).first()[0]
        assert abs(got - want) < 1e-9 * want, (a, b, got, want)
    rows = [("x", "The Answer is here", ["answer", "gone"], ["HERE"]), ("y", "", [], [])]
    got = {x["name"]: (x["recall"], x["leakage"]) for x in evaluation.signal_scores(spark.createDataFrame(rows, "name string, text string, expected array<string>, excluded array<string>")).collect()}
    assert got == {"x": (0.5, 1.0), "y": (1.0, 0.0)}
    assert evaluation.diff("a\nb", "a\nc\nd")["added"] == 2 and evaluation.diff("a\nb", "a\nc\nd")["removed"] == 1


def test_warehouse(spark):
    t = spark.createDataFrame([(1, 1, "queue"), (1, 2, "claim"), (1, 3, "cancel"), (1, 4, "finish"), (2, 1, "queue"), (2, 2, "claim"), (2, 3, "requeue"), (3, 1, "finish"), (4, 1, "queue"), (4, 2, "cancel"), (4, 3, "claim")], "job_id int, seq int, action string")
    assert {x["job_id"]: x["status"] for x in w.job_states(t).collect()} == {1: "cancelled", 2: "queued", 3: "new", 4: "cancelled"}
    urls = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "seq int, url string")
    assert [x["url"] for x in w.batch_remaining(urls, spark.createDataFrame([("a",)], "url string")).collect()] == ["b", "c"]
    leases = spark.createDataFrame([(1, "running", 5.0), (2, "running", 50.0), (3, "queued", 1.0)], "job_id int, status string, lease_until double")
    assert [x["job_id"] for x in w.expired_leases(leases, 10.0).collect()] == [1]


def test_rate_limit_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    times = [0, 1, 2, 30, 61, 62, 63, 200]
    rows = [(i, start + timedelta(seconds=s), u, "click", 1.0, "{}") for u in (1, 2) for i, s in enumerate(times, 100 * u)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = usage.drain(usage.admitted(usage.read_events(spark, f"file://{tmp_path}"), 2, 60), "append")
    got = {(x["user_id"], x["event_id"]) for x in out.filter("admitted").collect()}
    assert got == {(u, 100 * u + i) for u in (1, 2) for i in (0, 1, 4, 5, 7)}
