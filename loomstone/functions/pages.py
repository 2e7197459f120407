"""Columns over raw HTML: title, readable text, challenge signals, size, coverage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.native_text import let

# Sizes that tell a page from an interstitial or an app shell.
SHORT_CHARS, VERY_SHORT_CHARS, SHELL_CHARS = 1500, 600, 250

# What only interstitials have as their whole title.
CHALLENGE_TITLES = [
    ("title: just a moment", r"^just a moment\.*$"),
    ("title: attention required (cloudflare)", r"^attention required!? \| cloudflare$"),
    ("title: client challenge", r"^client challenge$"),
    ("title: ddos-guard", r"^ddos-guard$"),
    ("title: pardon our interruption", r"^pardon our interruption\.*$"),
    ("title: are you a robot", r"^are you a (?:robot|human)\??$"),
    ("title: human verification", r"^(?:human verification|verify you are human)$"),
]
# Titles, markers and phrases that count on short pages.
SHORT_TITLES = [
    ("title: access denied", r"^access (?:to this page has been )?denied"),
    ("title: security check", r"^(?:security check|one more step)"),
    ("title: captcha", r"captcha"),
]
VENDORS = [
    ("cloudflare challenge platform", r"/cdn-cgi/challenge-platform/"),
    ("cloudflare turnstile", r"challenges\.cloudflare\.com"),
    ("datadome", r"captcha-delivery\.com|geo\.captcha-delivery|datadome"),
    ("perimeterx", r"px-captcha|perimeterx|/_px\d*/|human security"),
    ("imperva/incapsula", r"_incapsula_resource|incapsula incident"),
    ("aws waf", r"awswaf|aws-waf-token|challenge\.js"),
    ("radware", r"perfdrive\.com|shieldsquare"),
    ("ddos-guard", r"ddos-guard"),
    ("fastly client challenge", r"/_fs-ch-"),
    ("sucuri", r"sucuri website firewall"),
    ("recaptcha/hcaptcha", r"g-recaptcha|h-captcha|hcaptcha\.com"),
]
WALLS = [("amazon bot check", r"/errors/validateCaptcha")]
PHRASES = [
    ("click the button below to continue shopping", r"click the button below to continue shopping"),
    ("client challenge", r"client challenge"),
    ("required part of this site couldn't load", r"required part of this site (?:couldn[’']t|could not) load"),
    ("disable any ad blockers", r"disable (?:any|your) ad ?blockers?"),
    ("verifying you are human", r"verify(?:ing)? (?:that )?you are (?:a )?human"),
    ("checking your browser", r"checking (?:if the site connection is secure|your browser)"),
    ("enable javascript and cookies", r"enable javascript and cookies to continue"),
    ("press and hold", r"press (?:&|and) hold"),
    ("unusual traffic", r"unusual traffic from your (?:computer )?network"),
    ("blocked as a robot", r"we suspect (?:that )?you(?:[’']re| are) a (?:robot|bot)|you(?:[’']ve| have) been blocked"),
    ("not a robot", r"(?:confirm|prove|verify) (?:that )?you(?:'re| are) not a (?:robot|bot)"),
]

_SCRIPTS = r"(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>"
_BLOCKS = (
    r"(?i)</?(?:p|div|section|article|main|aside|header|footer|nav|ul|ol|li|table|tr|td|th|h[1-6]|br|hr|form|figure|"
    r"figcaption|blockquote|pre|dl|dt|dd)\b[^>]*>"
)
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def title(html: Column) -> Column:
    """The first title, white space collapsed; empty if there is none."""
    return squeeze(F.coalesce(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1), F.lit("")))


def plain_text(html: Column) -> Column:
    """Readable text, a line for each block: scripts and styles dropped, tags removed."""
    cleaned = F.regexp_replace(F.coalesce(html, F.lit("")), _SCRIPTS, "\n")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, _BLOCKS, "\n"), "<[^>]+>", " ")
    lines = F.transform(F.split(cleaned, LINE_BREAK), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def needs_javascript(html: Column) -> Column:
    """Whether a page ships scripts and next to no readable text; noscript text does not count."""
    bare = F.regexp_replace(html, r"(?is)<noscript\b[^>]*>.*?</noscript\s*>", " ")
    few = F.length(no_space(plain_text(bare))) < SHELL_CHARS
    return F.coalesce(html.rlike(r"(?i)<script\b") & few, F.lit(False))


def _hits(column: Column, table: list[tuple[str, str]], prefix: str = "") -> Column:
    return F.array_compact(F.array(*(F.when(column.rlike("(?i)" + p), F.lit(prefix + name)) for name, p in table)))


def challenge(html: Column, text: Column) -> Column:
    """Struct of signals and text_chars: why a page looks like a bot challenge, empty if it does not.

    An interstitial's title is enough.  On short pages two kinds of evidence
    (titles, vendors, phrases) are needed, or a phrase or wall on a very short one.
    """
    html = F.coalesce(html, F.lit(""))
    none = F.array().cast("array<string>")
    some = lambda a: (F.size(a) > 0).cast("int")

    def evidence(page: Column) -> Column:
        return F.struct(
            _hits(page["name"], SHORT_TITLES).alias("titles"), _hits(html, VENDORS, "vendor: ").alias("vendors"),
            _hits(html, WALLS, "vendor: ").alias("walls"), _hits(page["text"], PHRASES).alias("phrases"),
        )

    def weighed(page: Column, e: Column) -> Column:
        kinds = some(e["titles"]) + some(e["vendors"]) + some(e["phrases"])
        short = (some(e["phrases"]) + some(e["walls"]) > 0) & (page["chars"] <= VERY_SHORT_CHARS)
        return F.when((kinds >= 2) | short, F.concat(e["titles"], e["vendors"], e["walls"], e["phrases"])).otherwise(none)

    def judged(page: Column) -> Column:
        # Long pages skip all but the titles; what is used twice is bound once.
        more = F.when(page["chars"] <= SHORT_CHARS, let(evidence(page), lambda e: weighed(page, e))).otherwise(none)
        return F.struct(F.concat(_hits(page["name"], CHALLENGE_TITLES), more).alias("signals"), page["chars"].alias("text_chars"))

    def counted(t: Column) -> Column:
        return F.struct(title(html).alias("name"), t.alias("text"), F.length(no_space(t)).alias("chars"))

    return let(let(F.coalesce(text, F.lit("")), counted), judged)


def estimate_tokens(text: Column) -> Column:
    """Four characters a token, one at least; none for no text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("bigint")


def anchors(html: Column) -> Column:
    """All href values of a elements, as written."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))


def head_cut(text: Column, limit: int) -> Column:
    """Struct of the first ``limit`` characters and how many were left out; 0 means no limit."""
    if limit <= 0:
        return F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("omitted"))
    return F.struct(
        F.substring(text, 1, limit).alias("text"),
        F.greatest(F.length(text) - limit, F.lit(0)).cast("bigint").alias("omitted"),
    )


def prompt_html(html: Column, limit: int = 40_000) -> Column:
    """HTML for a prompt: from the body on, without scripts, styles, vector art and comments, collapsed and cut."""
    start = F.instr(F.lower(html), "<body")
    body = F.when(start > 0, F.substring(html, start, F.length(html))).otherwise(html)
    noise = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "svg", "noscript", "template"))
    body = F.regexp_replace(body, f"(?is){noise}|<!--.*?-->", "")
    return F.substring(F.regexp_replace(body, r"(?U)\s+", " "), 1, limit)


def markdown_counts(md: Column) -> Column:
    """Struct of heading lines, fence lines, table lines and links of a Markdown text."""
    lines = F.split(md, LINE_BREAK)
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("bigint")
    return F.struct(
        count(r"(?U)^#{1,6}\s+").alias("headings"), count("^```").alias("fences"), count(r"(?U)^\s*\|").alias("table_rows"),
        F.regexp_count(md, F.lit(r"\[[^\]]+\]\([^)]+\)")).cast("bigint").alias("links"),
    )


COOKIE = (
    r"\b(?:cookies?\s+consent|we\s+use\s+cookies|this\s+(?:site|website)\s+uses\s+cookies|"
    r"cookie\s+(?:policy|settings|preferences|notice)|accept\s+(?:all\s+)?cookies|manage\s+cookies?|"
    r"by\s+continuing\s+you\s+accept|consent\s+to\s+cookies)\b"
)


def without_cookie_lines(text: Column) -> Column:
    """Lines that read as cookie notices dropped."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike("(?i)" + COOKIE)), "\n")


def markdown_text(md: Column) -> Column:
    """Plain lines of a Markdown text: markers of headings, lists and quotes dropped, blank and cookie lines too."""

    def bare(line: Column) -> Column:
        out = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        for marker in (r"(?U)^#{1,6}\s+", r"(?U)^[-*+]\s+", r"(?U)^>\s*", r"(?U)^\d+[.)]\s+"):
            out = F.regexp_replace(out, marker, "")
        return out

    lines = F.transform(F.split(md, LINE_BREAK), bare)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike("(?i)" + COOKIE)), "\n")


def classify_result(readable: Column, status: Column, has_error: Column) -> Column:
    """Benchmark class of a tool's output: junk, failed, thin or content."""
    junk = readable.rlike(
        "(?i)just a moment|verify(?:ing)? (?:that )?you are (?:a )?human|checking your browser|enable javascript and cookies|"
        "are you a robot|captcha|access denied|403 forbidden|request blocked|unusual traffic|client challenge"
    )
    n = F.length(readable)
    return (
        F.when((n == 0) & has_error, "failed").when(n == 0, "thin").when((n < 3000) & junk, "junk")
        .when(F.coalesce(status, F.lit(0)) >= 400, "failed").when(has_error & (n < 3000), "failed").when(n < 300, "thin").otherwise("content")
    )
