import time

import pytest
from loomstone.functions import errors, facts, pages, urls
from loomstone.functions.content import Page
from loomstone.functions.html_tree import Tree
from loomstone.functions.markdown import page_markdown
from loomstone.functions.passages import chunks, cite, outline, section, tokens, within_budget
from loomstone.operators.page_parse import parse_pages
from pyspark.sql import functions as F

LONG = "Plain words about the matter at hand, long enough to count as content. " * 4


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("html", "signals"),
    [
        ("<title>Just a moment...</title>" + LONG * 20, ["title: just a moment"]),
        ("<title>Log in</title><div class=g-recaptcha></div>" + LONG * 9, []),
        ("<title>Access denied</title>sorry", []),
        ("<title>Access denied</title><script src='/cdn-cgi/challenge-platform/x'></script>", ["title: access denied", "vendor: cloudflare challenge platform"]),
        ("<p>Checking your browser before you go on", ["checking your browser"]),
        ("<form action='/errors/validateCaptcha'>", ["vendor: amazon bot check"]),
        ("<p>An essay on how sites say: verifying you are human.</p>" + LONG * 9, []),
        (None, []),
    ],
)
def test_challenges(spark, html, signals):
    v = pages.challenge(F.col("html"), pages.plain_text(F.col("html")))
    assert one(spark, v, html=html)["signals"] == signals


def test_plain_text_and_scripts(spark):
    html = "<title>T  x</title><style>p{}</style><p>a&amp;b <b>c</b><br>d<script>var x='<p>'</script><noscript>please</noscript>"
    assert one(spark, pages.plain_text(F.col("h")), h=html) == "T x\na&amp;b c\nd\nplease"
    assert one(spark, pages.needs_javascript(F.col("h")), h=html) is True
    assert one(spark, pages.needs_javascript(F.col("h")), h=html + LONG * 9) is False
    assert one(spark, pages.markdown_text(F.col("h")), h="# H\n\n- a\n> q\n3) x\nWe use cookies here\n+ y") == "H\na\nq\nx\ny"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Example.com:80", "http://www.example.com/"),
        ("https://a.b:443/x?b=2&utm_source=q&a=1&FBCLID=3#f", "https://a.b/x?a=1&b=2"),
        ("https://a.b.:8443/x/", "https://a.b:8443/x/"),
        ("mailto:x@y.z", "mailto:x@y.z"),
        (" http://a.b/?a=2&a=1&b ", "http://a.b/?a=1&a=2&b="),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize(F.col("u")), u=url) == want
    assert facts.canonical_url(url) == want


def test_url_predicates(spark):
    assert one(spark, urls.redact_url(F.col("u")), u="https://a/?q=1&Session_Id=9&x#token=1") == "https://a/?q=1&Session_Id=REDACTED&x#token=1"
    assert one(spark, urls.same_site(F.col("u"), F.lit("https://www.a.com/")), u="https://b.a.com/") is True
    assert one(spark, urls.same_site(F.col("u"), F.lit("https://www.a.com/")), u="https://ba.com/") is False
    with pytest.raises(ValueError):
        urls.check_patterns(["("])
    with pytest.raises(ValueError):
        urls.check_patterns(["x"] * 21)
    assert facts.canonical_url("http://Bücher.example/ü?q=ü") == "http://xn--bcher-kva.example/ü?q=%C3%BC"


@pytest.mark.parametrize(
    ("message", "want"),
    [("HTTP Error 403: x", "blocked"), ("Tunnel connection failed: 403 Forbidden", "network_error"), ("chromium: certificate bad", "tls_error"), ("", None), ("??", "fetch_error"), (None, None)],
)
def test_error_classes(spark, message, want):
    assert one(spark, errors.classify(F.col("m")), m=message) == want


def test_sanitize_and_coverage(spark):
    assert one(spark, errors.sanitize(F.col("m")), m="a\x00\n b https://u:p@h/x") == "a b https://***@h/x"
    assert len(one(spark, errors.sanitize(F.col("m")), m="x" * 999)) == 300
    c = lambda e, n=0, chars=1, **f: spark.range(1).select(errors.coverage(F.lit(e).cast("string"), F.lit(n), {k: F.lit(v) for k, v in f.items()}, F.lit(chars)).alias("c")).first()["c"]
    assert tuple(c("blocked")) == ("blocked", ["blocked"]) and tuple(c(None, 1)) == ("failed", ["fetch_error"])
    assert tuple(c(None, markdown_truncated=True)) == ("truncated", ["token_budget"]) and tuple(c(None)) == ("complete", [])
    assert tuple(c(None, 0, 0, markdown_truncated=True, javascript_required=True)) == ("partial", ["needs_javascript", "empty_page", "token_budget"])


def test_tree_closes_what_html_leaves_open():
    t = Tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<div>y</div></i>")
    parents = [t.tag[t.parent[i]] for i in t.elements() if t.tag[i] in ("li", "td", "div")]
    assert parents == ["ul", "ul", "ul", "ul", "tr", "tr", "tr", "document"]
    assert t.string(0) == "a b c d 1 2 3 x y"
    assert all(t.size(i) == len(t.string(i)) for i in range(len(t.tag)) if t.tag[i])


def test_main_content():
    html = f"""<body class="has-sidebar"><nav><a href=/>Home</a></nav><div class="sidebar"><a href=/1>one</a><a href=/2>two</a></div>
    <main><h1>Title</h1><p>{LONG}<p>{LONG}<div role=tabpanel hidden>Tab text</div><p style="display:none !important">secret</p>
    <p>We use cookies to follow you</p><div class="ads">buy</div><form><input></form></main><footer>foot</footer>"""
    md = page_markdown(html)
    assert md.startswith("# Title") and "Tab text" in md
    for gone in ("Home", "one", "secret", "cookies", "buy", "foot"):
        assert gone not in md
    assert Page(Tree(html)).main()[0] > 0


def test_never_empty():
    html = f'<div class="sidebar hidden"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>'
    assert "Plain words" in page_markdown(html)


def test_rendering():
    html = """<h2>Head</h2><p>A <em>b</em> <a href="x y?z">link</a> <a href="javascript:no">js</a><img src=i.png alt=pic></p>
    <ol><li>one<li>two</ol><table><tr><th>A<th><th>B<tr><td>1<td><td>2|3</table><pre><code class="language-js">let a;\n\n  b</code></pre><hr>"""
    assert page_markdown(html, "https://e.com/d/").split("\n\n") == [
        "## Head", "A _b_ [link](https://e.com/d/x y?z) js![pic](https://e.com/d/i.png)", "1. one\n2. two",
        "| A | B |\n| --- | --- |\n| 1 | 2\\|3 |", "```javascript\nlet a;", "  b\n```", "---",
    ]


def test_deep_pages_take_linear_time():
    began = time.time()
    page_markdown("<div class=x>" * 40_000 + "deep" + "</div>" * 40_000)
    assert time.time() - began < 20


MD = "intro text\n\n# A\n\nalpha beta\n\n## B\n\n```\n# no heading\n\nx\n```\n\n# C\n\n" + "long line of words " * 60


def test_chunks_outline_sections():
    got = chunks(MD, "https://e.com/p#f", 50)
    assert all(c["estimated_tokens"] <= 50 for c in got) and [c["id"] for c in got] == list(range(len(got)))
    assert got[0]["heading"] == "" and any(c["heading"] == "A > B" and "# no heading" in c["text"] for c in got)
    assert "".join("".join(c["text"].split()) for c in got) == "".join(MD.split())
    assert cite("https://e.com/p#f", "- well-known *things* here") == "https://e.com/p#:~:text=well%2Dknown%20things%20here"
    o = outline(MD)
    assert [(x["id"], x["heading"], x["level"]) for x in o] == [("s1", "(before the first heading)", 0), ("s2", "A", 1), ("s3", "A > B", 2), ("s4", "C", 1)]
    assert o[1]["tokens"] == tokens("# A\n\nalpha beta") + o[2]["tokens"]
    assert section(MD, "s3") == section(MD, "b") and section(MD, "A").startswith("# A") and section(MD, "zz") is None


def test_within_budget():
    md = "# H\n\nnothing\n\n# K\n\nthe answer is here\n\nother"
    assert within_budget(md, [0, 0, 0, 2.0, 0], 60) == "# K\n\nthe answer is here"
    assert within_budget(md, [0, 0, 0, 2.0, 0], 5) is None


def test_facts():
    html = """<html lang=en><head><base href="/b/"><title> A  B </title><meta name=Description content=" d "><link rel=canonical href="c">
    <script type="application/ld+json">{"@graph":[{"@type":["Product","X"],"name":"N","offers":[{"price":9.5,"availability":"http://s/InStock"}],"aggregateRating":{"ratingValue":"4"}}]}</script>
    <script type="application/ld+json">broken</script></head><a href="x?utm_a=1">1</a><a href="x">2</a><a href="mailto:m">3</a>"""
    links, meta = facts.facts(Tree(html), "https://e.com/a/")
    assert links == ["https://e.com/b/x", "mailto:m"]
    assert meta == {
        "language": "en", "title": "A B", "description": "d", "canonical": "https://e.com/b/c", "jsonld_count": "2", "schema_types": "Product,X",
        "product_name": "N", "product_price": "9.5", "product_availability": "InStock", "product_rating_value": "4",
    }


def test_parse_pages(spark):
    df = spark.createDataFrame([(1, "https://e.com", f"<h1>T</h1><p>{LONG}<p>{LONG}"), (2, None, None), (3, "u", "")], "page_id int, url string, html string")
    rows = parse_pages(df.repartition(2), ["markdown", "links", "metadata", "provenance", "chunks", "outline", "text_chars"]).collect()
    assert len(rows) == 3 and {r["page_id"]: r["markdown"] for r in rows}[2] == ""
    with pytest.raises(ValueError):
        parse_pages(df, ["pdf"])
    assert parse_pages(df.limit(0), ["markdown"]).count() == 0
