"""Personal data: known shapes, and unseen identifiers by bootstrapped contexts.

Spans of the known shapes are seeds.  The two words before a seed are a lexical
pattern, whatever stands behind them an instance, known or not yet.  Patterns
and instances make a graph of counts, scored in turns: a pattern is as good as
the instances it precedes, weighed against all that ever follows it; an instance
is as likely as the patterns that precede it make it.  Unseen instances of
patterns with a high score become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.columns import pick
from loomstone.llm.native import WS, joined, let, matches, replaced
from loomstone.runtime import drop_table, persist_table

# The known shapes.  Possessive forms match what the plain ones do
# and keep the regex engine from going back over long runs.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_GATE = r"[0-9](?:[\x20-]?[0-9]){15}"
BASE_KINDS = ["email", "ip", "card", "phone"]
#: What is cut off around a word that stands in the place of an identifier (fixed value).
MARKS = "!\"'(),.:;<>?[]{}|*"
ROUNDS = 3
#: What a pattern needs: its score, different seeds that it precedes, and the share of its places that seeds fill.
MIN_SCORE, MIN_SEEDS, MIN_SHARE = 0.8, 5, 0.5
#: What an unseen instance needs.
MIN_BELIEF = 0.5
#: The largest Bloom filter, in bits (2 MB); beyond a quarter as many hashes none is used.
MASK_BITS = 1 << 24


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of figures passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add, lambda t: t % 10 == 0)


def _is_card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


def _is_ip(value: Column) -> Column:
    small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    return F.forall(F.split(value, r"\."), small)


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


def _shapes(text: Column) -> dict[str, Column]:
    has = lambda mark, shape: text.contains(mark) & text.rlike(shape)
    return {
        "email": matches(text, EMAIL, gate=has("@", r"@[A-Za-z0-9-]+\."), words=True),
        "ip": matches(text, IP, keep=_is_ip, words=True),
        "card": matches(text, CARD, gate=CARD_GATE, keep=_is_card, words=True),
        "phone": matches(text, PHONE, gate=has("+", PHONE), keep=_is_phone, words=True),
    }


def _lower_words(text: Column) -> Column:
    """The words in lower case; a blank text has one empty word."""
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), f"[{WS}]+")


def _contexts(words: Column) -> Column:
    """At k the hash of words k and k + 1, the context of word k + 2; null for the last two."""
    following = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    return F.zip_with(words, following, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def _seeds(text: Column, spans: Column) -> Column:
    """array<struct<context, value>>: one for each word in which a known span begins and that two words precede."""
    begun = F.array_sort(
        F.transform(F.filter(spans, lambda s: s["first"] >= 2), lambda s: F.struct(s["first"], s["start"], s["value"]))
    )
    once = let(begun, lambda b: F.filter(b, lambda s, i: (i == 0) | (F.get(b, i - 1)["first"] != s["first"])))
    found = let(
        _contexts(_lower_words(text)),
        lambda c: F.transform(
            once, lambda s: F.struct(F.get(c, s["first"] - 2).alias("context"), F.xxhash64(s["value"]).alias("value"))
        ),
    )
    return F.when(F.size(spans) > 0, found).otherwise(F.array().cast("array<struct<context:bigint,value:bigint>>"))


def known_spans(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """row, doc_id, text, span arrays email, ip, card, phone with their words, and the contexts of seeds, written.

    ``row`` numbers the rows; a written table keeps the numbers the same for all readers.
    """
    if carry is None:
        rows = pick(docs, "doc_id", "text")
    else:
        whole = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(0))
        rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), whole.alias("carried"))
    text = F.coalesce("text", F.lit(""))
    extra = [] if carry is None else ["carried"]
    shapes = rows.select("doc_id", "text", *extra, *(c.alias(k) for k, c in _shapes(text).items()))
    seeds = let(F.concat(*BASE_KINDS), lambda spans: _seeds(text, spans)).alias("seeds")
    row = F.monotonically_increasing_id().alias("row")
    return persist_table(shapes.select(row, "doc_id", "text", *extra, *BASE_KINDS, seeds), "pii-spans")


def _mask(hashes: DataFrame, column: str) -> tuple[DataFrame, int] | None:
    """A Bloom filter of a column of hashes as a frame of one row, ``mask`` array<bigint>, and its size in bits.

    Sixteen bits a hash at least and MASK_BITS at most, so the row is bounded;
    None where that is too small to be of use, and nothing is thinned out then.
    """
    n = hashes.count()
    if 4 * n > MASK_BITS:
        return None
    bits = min(MASK_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
    places = hashes.select(F.explode(F.array(*(_place(F.col(column), k, bits) for k in (0, 32)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).cast("bigint").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("b")
    )
    every = hashes.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left")
    row = F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))))
    return every.agg(F.transform(row, lambda x: x["b"]).alias("mask")), bits


def _place(h: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(bits - 1).cast("bigint")).cast("int")


def _masked(h: Column, mask: Column, bits: int) -> Column:
    """Whether the filter may hold the hash."""

    def held(k: int) -> Column:
        at = _place(h, k, bits)
        return F.getbit(F.get(mask, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1

    return held(0) & held(32)


def _thinned(rows: DataFrame, h: str, hashes: DataFrame, column: str) -> DataFrame:
    """The rows whose hash ``h`` may be among ``hashes``; others are gone, a few strangers stay."""
    made = _mask(hashes, column)
    if made is None:
        return rows
    mask, bits = made
    return rows.filter(_masked(F.col(h), mask.scalar(), bits))


def candidate_patterns(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contexts that may be patterns, and the seeds in them.

    (context, seeds, all): contexts of MIN_SEEDS different seeds at least, whose
    seeds fill MIN_SHARE at least of the ``all`` places that follow the context
    in the corpus.  (context, value, n): how often each seed stands in them.
    """
    seeds = persist_table(
        spans.filter(F.size("seeds") > 0).select(F.explode("seeds").alias("s")).groupBy("s.context", "s.value").agg(
            F.count("*").alias("n")
        ),
        "pii-seeds",
    )
    able = seeds.groupBy("context").agg(F.count("*").alias("seeds"), F.sum("n").alias("filled")).filter(F.col("seeds") >= MIN_SEEDS)
    able = persist_table(able, "pii-able")
    followed = spans.select(_lower_words(F.coalesce("text", F.lit(""))).alias("w")).select(
        F.explode(let(F.col("w"), _contexts)).alias("h")
    )
    counts = _thinned(followed, "h", able, "context").groupBy("h").agg(F.count("*").alias("all"))
    share = F.col("filled") / F.col("all")
    chosen = able.join(counts, able.context == counts.h).filter(share >= MIN_SHARE).select("context", "seeds", "all")
    chosen = persist_table(chosen, "pii-candidates")
    kept = seeds.join(chosen.select("context"), "context", "left_semi")
    drop_table(able)
    return chosen, kept


def _fillers(spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row, start, end, core, context): words in the slot of a chosen context that touch no known span."""
    made = _mask(chosen, "context")
    rows = spans.select("row", F.coalesce("text", F.lit("")).alias("text"), F.concat(*BASE_KINDS).alias("known"))
    rows = rows.withColumn("mask", made[0].scalar() if made else F.lit(None).cast("array<bigint>"))
    may = (lambda h, mask: _masked(h, mask, made[1])) if made else (lambda h, mask: F.lit(True))

    def slots(c: Column) -> Column:
        """Words that a context which may be chosen precedes, apart from those of known spans."""
        hit = F.array_compact(F.transform(c, lambda h, i: F.when(may(h, F.col("mask")), i + 2)))
        taken = F.flatten(F.transform("known", lambda s: F.sequence(s["first"], s["last"])))
        return let(hit, lambda x: F.when(F.size(x) > 0, F.array_except(x, taken)).otherwise(x))

    def cored(word: Column, context: Column) -> Column:
        head = F.ltrim(word["value"], F.lit(MARKS))
        core = F.rtrim(head, F.lit(MARKS))
        start = word["start"] + F.length(word["value"]) - F.length(head)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("core"), context.alias("context"))

    def found(c: Column) -> Column:
        words = matches(F.col("text"), f"[^{WS}]++")
        made = lambda places: let(words, lambda w: F.transform(places, lambda i: cored(F.get(w, i), F.get(c, i - 2))))
        none = F.array().cast("array<struct<start:int,end:int,core:string,context:bigint>>")
        return let(slots(c), lambda x: F.when(F.size(x) > 0, made(x)).otherwise(none))

    each = rows.select("row", F.explode(let(_contexts(_lower_words(F.col("text"))), found)).alias("f")).select("row", "f.*")
    return each.filter("core != ''").join(chosen.select("context"), "context", "left_semi").select(
        "row", "start", "end", "core", "context"
    )


def discover(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """(row, start, end, value): unseen identifiers, by rounds over the graph of patterns and instances; None for none.

    A pattern's score is the belief in what it precedes, over all that follows
    it.  Seeds are certain.  Another instance is as likely as not all its
    patterns are wrong, weighed by the share of its places in the corpus that
    stand behind patterns, so that everyday words are no identifiers.
    """
    chosen, seeds = candidate_patterns(spans)
    if chosen.isEmpty():
        return None
    fillers = persist_table(_fillers(spans, chosen).withColumn("value", F.xxhash64(F.lower("core"))), "pii-fillers")
    if fillers.isEmpty():
        return None
    values = persist_table(fillers.groupBy("value").agg(F.count("*").alias("behind")), "pii-values")
    words = spans.select(F.explode(_lower_words(F.coalesce("text", F.lit("")))).alias("w")).select(
        F.xxhash64(F.rtrim(F.ltrim("w", F.lit(MARKS)), F.lit(MARKS))).alias("h")
    )
    everywhere = _thinned(words, "h", values, "value").groupBy("h").agg(F.count("*").alias("everywhere"))
    own = values.join(everywhere, values.value == everywhere.h).select(
        "value", F.least(F.lit(1.0), F.col("behind") / F.col("everywhere")).alias("own")
    )
    unseen = fillers.groupBy("context", "value").agg(F.count("*").alias("n")).join(own, "value")
    edges = persist_table(
        seeds.select("context", "value", "n", F.lit(None).cast("double").alias("own")).unionByName(
            unseen.select("context", "value", "n", "own")
        ).join(chosen, "context"),
        "pii-graph",
    )
    belief = edges.withColumn("p", F.col("own").isNull().cast("double"))
    for _ in range(rounds):
        mass = belief.groupBy("context", "seeds", "all").agg(F.sum(F.col("n") * F.col("p")).alias("mass"))
        score = mass.select("context", F.least(F.lit(1.0), F.col("mass") / F.col("all")).alias("score"))
        wrong = F.exp(F.sum(F.ln(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        likely = edges.filter("own is not null").join(score, "context").groupBy("value", "own").agg(
            (F.col("own") * (1 - wrong)).alias("q")
        )
        belief = edges.join(likely.select("value", "q"), "value", "left").withColumn(
            "p", F.when(F.col("own").isNull(), 1.0).otherwise(F.coalesce("q", F.lit(0.0)))
        )
    good = persist_table(score.filter(F.col("score") >= MIN_SCORE).select("context"), "pii-patterns")
    sure = persist_table(likely.filter(F.col("q") >= MIN_BELIEF).select("value"), "pii-sure")
    found = fillers.join(good, "context", "left_semi").join(sure, "value", "left_semi")
    out = persist_table(found.select("row", "start", "end", F.col("core").alias("value")).distinct(), "pii-found")
    for t in (fillers, values, edges, good, sure):
        drop_table(t)
    return out


def find_pii(docs: DataFrame, keep_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, text (if keep_text), span arrays email, ip, card, phone, context.

    carry: more columns of ``docs`` to return, as the struct ``carried``.
    Spans are struct<start, end, value> in code points, end exclusive; ``context``
    spans are the unseen identifiers of :func:`discover` and touch no other span.
    A pattern is the two whole words, of any length, before the word in which a
    known span begins (words end at ASCII white space and are compared in lower
    case); instances are whatever stands in that place, without the MARKS around
    it.  Null and empty texts have no spans; a null doc_id stays; repeated rows
    are searched each; an empty table gives no rows.

    Texts are worked through once for the spans, which are written beside them,
    once to count what follows the contexts of seeds, and twice more only where
    contexts pass.  Only hashes, summed in each task, and spans are shuffled.
    """
    own = [*(["text"] if keep_text else []), *(["carried"] if carry is not None else [])]
    spans = known_spans(docs, carry)
    new = discover(spans)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    bare = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias(k) for k in BASE_KINDS]
    if new is None:
        return spans.select("doc_id", *own, *bare, none.alias("context"))
    listed = persist_table(
        new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("context")), "pii-listed"
    )
    return spans.join(listed, "row", "left").select("doc_id", *own, *bare, F.coalesce("context", none).alias("context"))


def seed_counts(docs: DataFrame) -> DataFrame:
    """(kind, spans, seeds): how many known spans of each kind there are, and how many of them two words precede."""
    spans = known_spans(docs)
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("s")) for k in BASE_KINDS))
    rows = spans.select(F.explode(each).alias("e")).select(
        "e.kind", F.size("e.s").alias("n"), F.size(F.filter("e.s", lambda s: s["first"] >= 2)).alias("m")
    )
    return rows.groupBy("kind").agg(F.sum("n").alias("spans"), F.sum("m").alias("seeds"))


KINDS = [*BASE_KINDS, "context"]


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and span lists of :func:`find_pii` per document."""
    found = find_pii(docs, keep_text=False)
    kinds = [(k, F.col(k)) for k in KINDS]
    return found.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(kinds[:4], False), 256).alias("base_sha256"),
        joined(kinds, False).alias("spans"),
    )


def redacted(text: Column, spans: list[tuple[str, Column]]) -> Column:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap, the first."""

    def named(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark"))

    return replaced(text, F.concat(*(F.transform(c, named(k)) for k, c in spans)))
