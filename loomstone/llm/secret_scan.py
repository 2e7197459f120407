"""Secret scans: known shapes, and strings whose windows look random.

Everything is a column expression: nothing is shuffled, and a row needs no more
memory than its own text and spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.columns import pick
from loomstone.llm.native import joined, let, matches, replaced

# The known shapes.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: What may be a secret by its randomness alone.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Strings that look random and are none, or are meant to be shown (fixed values, matched in any case).
ALLOWED = [
    "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    ".*(example|sample|dummy|placeholder|changeme|your[_-]?key|xxxx|0123456789|abcdefgh|qwerty).*",
    "sha(1|256|384|512)-.*",
    "[a-z]+([_/-][a-z]+)+",
]
WINDOW = 20


@dataclass(frozen=True)
class Entropy:
    """What a window of a class must have: bits of entropy, figures, capitals, small letters, changes between these, and other marks at most."""

    bits: float
    figures: int
    uppers: int
    lowers: int
    changes: int
    marks: int = 0


#: Classes of windows that are not hexadecimal.  ``lower`` has no capitals, ``upper`` no small letters, ``letters`` no figures.
#: Of random strings of 32 characters nine in ten and more have such a window (tests), of names in programs one in two hundred.
CLASSES = {
    "lower": Entropy(3.5, figures=3, uppers=0, lowers=0, changes=5),
    "upper": Entropy(3.4, figures=2, uppers=0, lowers=0, changes=4),
    "mixed": Entropy(3.7, figures=2, uppers=2, lowers=2, changes=9, marks=2),
    "letters": Entropy(3.8, figures=0, uppers=4, lowers=4, changes=9),
}
#: Windows of hexadecimal digits in one case: bits, and figures and letters each.
HEX_BITS, HEX_EACH = 2.9, 3


def _nlogn(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(0.0)


def _kind(c: Column) -> Column:
    """0 for figures, 1 for capitals, 2 for small letters, 3 for marks."""
    return F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3)


def _window_class(a: Column) -> Column:
    """The class that a full window meets, else null."""
    bits = F.log2(F.lit(float(WINDOW))) - a["total"] / WINDOW
    marks = WINDOW - a["figures"] - a["uppers"] - a["lowers"]
    alike = {"lower": a["uppers"] == 0, "upper": a["lowers"] == 0, "letters": a["figures"] == 0}
    is_hex = a["window"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    found = F.when(
        is_hex,
        F.when((bits >= HEX_BITS) & (a["figures"] >= HEX_EACH) & (WINDOW - a["figures"] >= HEX_EACH), "hex"),
    )
    for name, need in CLASSES.items():
        found = found.when(
            alike.get(name, F.lit(True)) & (bits >= need.bits) & (a["figures"] >= need.figures) & (a["uppers"] >= need.uppers)
            & (a["lowers"] >= need.lowers) & (a["changes"] >= need.changes) & (marks <= need.marks),
            name,
        )
    return found


def entropy_class(value: Column) -> Column:
    """The class of the first window of ``value`` that looks random; null if none does.

    One pass over the characters: a step takes the first character out of the
    window and one in at its end, and corrects the running sum of n log n, the
    counts of figures, capitals and small letters, and the changes between
    neighbours by these two alone.
    """
    one = lambda c: F.when(c, 1).otherwise(0)

    def without_first(a: Column) -> Column:
        w, first = a["window"], F.substring(a["window"], 1, 1)
        n = F.length(w) - F.length(F.replace(w, first, F.lit("")))
        kind = _kind(first)
        moved = F.struct(
            F.substring(w, 2, WINDOW).alias("window"),
            (a["total"] - _nlogn(n) + _nlogn(n - 1)).alias("total"),
            (a["figures"] - one(kind == 0)).alias("figures"),
            (a["uppers"] - one(kind == 1)).alias("uppers"),
            (a["lowers"] - one(kind == 2)).alias("lowers"),
            (a["changes"] - one(kind != _kind(F.substring(w, 2, 1)))).alias("changes"),
            a["found"].alias("found"),
        )
        return F.when(F.length(w) == WINDOW, moved).otherwise(a)

    def with_next(a: Column, c: Column) -> Column:
        w, kind = a["window"], _kind(c)
        n = F.length(w) - F.length(F.replace(w, c, F.lit("")))
        return F.struct(
            F.concat(w, c).alias("window"),
            (a["total"] - _nlogn(n) + _nlogn(n + 1)).alias("total"),
            (a["figures"] + one(kind == 0)).alias("figures"),
            (a["uppers"] + one(kind == 1)).alias("uppers"),
            (a["lowers"] + one(kind == 2)).alias("lowers"),
            (a["changes"] + one((w != "") & (kind != _kind(F.substring(w, -1, 1))))).alias("changes"),
            a["found"].alias("found"),
        )

    def step(a: Column, c: Column) -> Column:
        judged = lambda b: b.withField("found", F.when(F.length(b["window"]) == WINDOW, _window_class(b)))
        return F.when(a["found"].isNotNull(), a).otherwise(let(let(without_first(a), lambda b: with_next(b, c)), judged))

    zero = F.struct(
        F.lit("").alias("window"), F.lit(0.0).alias("total"), F.lit(0).alias("figures"), F.lit(0).alias("uppers"),
        F.lit(0).alias("lowers"), F.lit(0).alias("changes"), F.lit(None).cast("string").alias("found"),
    )
    return F.aggregate(F.split(value, ""), zero, step, lambda a: a["found"])


def looks_random(value: Column) -> Column:
    """Whether a candidate has a random window and is on no allow-list."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(f"(?i)^(?:{pattern})$")
    # A string without capitals or without small letters needs figures, and every class letters.
    may = value.rlike("[A-Za-z]") & (value.rlike("[0-9]") | (value.rlike("[A-Z]") & value.rlike("[a-z]"))) & ~allowed
    return F.when(may, entropy_class(value).isNotNull()).otherwise(False)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, text and the span arrays assign, access, hex, entropy.

    Spans are struct<start, end, value> in code points, end exclusive.  ``assign``
    needs a value of six characters at least.  ``entropy`` spans are random
    looking strings that touch no span of another kind.  Null and empty texts
    have no spans; a null doc_id stays; repeated rows are scanned each; an empty
    table gives no rows.
    """
    rows = pick(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    # The value starts after the last quote, sign or space that the key is followed by.
    value = lambda hit: F.regexp_extract(hit, ASSIGN, 1)
    base = rows.select(
        "doc_id",
        "text",
        matches(text, ASSIGN, keep=lambda h: F.length(value(h)) >= 6).alias("assign"),
        matches(text, ACCESS).alias("access"),
        matches(text, HEX).alias("hex"),
        matches(text, CANDIDATE, gate=r"[A-Za-z0-9+/_=-]{20}", keep=looks_random).alias("random"),
    )
    free = F.filter(
        "random",
        lambda r: ~F.exists(
            F.concat("assign", "access", "hex"), lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])
        ),
    )
    return base.select("doc_id", "text", "assign", "access", "hex", free.alias("entropy"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts and span lists of :func:`find_secrets` per document."""
    found = find_secrets(docs)
    kinds = [(k, F.col(k)) for k in ("assign", "access", "hex", "entropy")]
    return found.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k, _ in kinds),
        F.sha2(joined(kinds[:3], True), 256).alias("base_sha256"),
        joined(kinds, True).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """doc_id and text with every span replaced by ``mark``; overlapping spans are replaced once."""
    found = find_secrets(docs)
    spans = F.transform(
        F.concat("assign", "access", "hex", "entropy"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark).alias("mark"))
    )
    return found.select("doc_id", replaced(F.col("text"), spans).alias("text"))
