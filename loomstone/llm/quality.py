"""Quality rules with risk-controlled thresholds.

Fixed rules reject texts that are too short or mostly repeat themselves.  The
other rules are cutoffs on features, chosen from labelled documents so that
good documents are rarely lost.  A third of the labels proposes: for each
stratum, the cutoff of each feature that gains most (poor documents rejected,
less ten for each good one), the most useful feature first.  The other two
thirds decide: the rule that rejects by the first cutoff, then by the first two,
and so on, is tested against the risk of losing good documents with an exact
binomial bound, up to the first that fails.  Such a fixed sequence needs no
further correction within a stratum; strata share the error by Bonferroni's rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.columns import pick
from loomstone.llm.native import WS, let
from loomstone.runtime import persist_table

SYMBOLS = "#*$%&|<>"
#: The features that have a cutoff; each is a share of the text that is high in poor texts.
FEATURES = ["symbol_share", "upper_share", "dup_line_share", "mark_share"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Cutoffs tried for each feature (a fixed grid: rejected is what lies above).
GRID = [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: No stratum loses more than RISK of its good documents, all strata together with probability 1 - DELTA.
RISK, DELTA = 0.03, 0.05
#: Good documents weigh this much in the choice among safe cutoffs.
PRICE = 10


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows with their places are sorted, equal neighbours mark the places that
    repeat, and a fold over those places in order counts the words they cover.
    """
    n = F.size(words)
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            again = F.filter(
                p,
                lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]),
            )
            order = F.array_sort(F.transform(again, lambda x: x["i"]))
            fold = F.aggregate(
                order,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["to"])).alias("n"), (i + 3).alias("to")),
                lambda a: a["n"],
            )
            return fold

        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(pairs, twice))

    return let(windows, covered)


def _facts(text: Column) -> Column:
    """A struct of the counts, shares and fixed verdict of a text (not null)."""

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
        without = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
            without(SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))).alias("lines"),
            _repeated(words).cast("bigint").alias("n_repeat_words"),
            without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            without("!?=_~^").alias("n_marks"),
            F.xxhash64(text).alias("digest"),
        )

    def shares(f: Column) -> Column:
        share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
        return F.struct(
            *(f[n].alias(n) for n in ("n_words", "word_chars", "n_symbols")),
            f["lines"]["again"].cast("bigint").alias("n_dup_lines"),
            f["n_repeat_words"].alias("n_repeat_words"),
            ((f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])).alias("base_failed"),
            share(f["n_symbols"], f["word_chars"]).alias("symbol_share"),
            share(f["n_upper"], f["word_chars"]).alias("upper_share"),
            share(f["lines"]["again"], f["lines"]["all"]).alias("dup_line_share"),
            share(f["n_marks"], f["word_chars"]).alias("mark_share"),
            f["digest"].alias("digest"),
        )

    return let(let(_words(text), counts), shares)


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, counts, shares and digest of every whole text; null text is empty, a null stratum is ''."""
    rows = pick(docs, "doc_id", "text", stratum)
    facts = _facts(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", F.coalesce(stratum, F.lit("")).alias("stratum"), facts.alias("f")).select("doc_id", "stratum", "f.*")


def _ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series after seven steps up."""
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    up = F.ln(x * (x + 1) * (x + 2)) + F.ln((x + 3) * (x + 4)) + F.ln((x + 5) * (x + 6))
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - up


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): the exact p-value of a rejection count against a risk of p.

    Terms are summed from k down with their ratios, as far as they still count:
    below the mean, terms fall off within some twelve standard deviations.
    """
    k, n = k.cast("double"), n.cast("double")
    top = _ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p))) + 60).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"), (a["sum"] + a["term"]).alias("sum")
        ),
        lambda a: a["sum"],
    )
    return F.when(k >= n, 1.0).otherwise(F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total)))


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, quality, the FEATURES and ``proposes`` of the labelled documents that pass the fixed rules.

    Equal texts of a stratum count once, since the bounds are for independent
    draws; near copies do not, so labels should be deduplicated where they abound.
    A hash of the text says which third a row is in.
    """
    known = pick(labels, "doc_id", "quality", types={"quality": "int"}).filter("doc_id is not null and quality in (0, 1)").distinct()
    rows = measured.filter(~F.col("base_failed")).join(known, "doc_id").select("stratum", "quality", "digest", *FEATURES).distinct()
    return rows.select("stratum", "quality", *FEATURES, (F.pmod("digest", F.lit(3)) == 0).alias("proposes"))


def proposals(rows: DataFrame) -> DataFrame:
    """(stratum, steps): the best cutoff of each feature that gains, array<struct<loss, feature, cutoff>>, the best first."""
    tall = rows.filter("proposes").select(
        "stratum", "quality",
        F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in FEATURES))).alias("f"),
    ).select(
        "stratum", "f.feature",
        F.when(F.col("quality") == 1, -PRICE).otherwise(1).alias("worth"),
        F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), (F.col("f.x") > c).cast("int").alias("out")) for c in GRID))).alias("g"),
    )
    gains = tall.groupBy("stratum", "feature", F.col("g.cutoff").alias("cutoff")).agg(
        F.sum(F.col("worth") * F.col("g.out")).alias("gain")
    )
    best = gains.filter("gain > 0").groupBy("stratum", "feature").agg(
        F.max("gain").alias("gain"), F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff")
    )
    step = F.struct((-F.col("gain")).alias("loss"), "feature", "cutoff")
    return best.groupBy("stratum").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, feature, cutoff, good, good_out, p): the safe cutoffs; no row where none is safe or gains.

    measured: from :func:`features`.  labels: doc_id, quality (1 good, 0 poor).
    good: good documents that decided; good_out: those lost by this cutoff and
    the stratum's better ones together; p: the chance of so few were the loss above
    ``risk``.  Only counts leave the tasks: strata x features x cutoffs rows.
    """
    rows = persist_table(labelled(measured, labels), "quality-labelled")
    steps = persist_table(proposals(rows), "quality-steps")
    strata = max(1, steps.count())
    value = F.create_map(*(x for f in FEATURES for x in (F.lit(f), F.col(f))))
    hits = F.transform("steps", lambda s: F.try_element_at(value, s["feature"]) > s["cutoff"])
    lost = rows.filter("not proposes and quality = 1").join(steps, "stratum").select(
        "stratum", F.array_position(hits, True).alias("first")
    )
    outs = [F.count_if(F.col("first").between(1, k)) for k in range(1, len(FEATURES) + 1)]
    counts = lost.groupBy("stratum").agg(F.count("*").alias("good"), F.array(*outs).alias("outs"))
    tested = steps.join(counts, "stratum").select(
        "stratum", "good",
        F.transform(
            "steps",
            lambda s, k: F.struct(
                s["feature"].alias("feature"), s["cutoff"].alias("cutoff"), F.get("outs", k).alias("good_out"),
                binomial_tail(F.get("outs", k), F.col("good"), risk).alias("p"),
            ),
        ).alias("tests"),
    )
    failed = F.array_position(F.transform("tests", lambda t: t["p"] > delta / strata), True)
    safe = F.when(failed > 0, F.slice("tests", F.lit(1), (failed - 1).cast("int"))).otherwise(F.col("tests"))
    return tested.select("stratum", "good", F.explode(safe).alias("t")).select(
        "stratum", "t.feature", "t.cutoff", "good", "t.good_out", "t.p"
    )


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons.

    ``kept`` is false if the fixed rules fail or a feature lies above its safe
    cutoff in the document's stratum.  A stratum with too few labels for a bound
    has no cutoffs and keeps what the fixed rules keep.  Null and empty texts
    fail the fixed rules.  A null doc_id is judged but never joined to labels;
    repeated rows are judged each; an empty table gives no rows.
    """
    measured = persist_table(features(docs, stratum), "quality-features")
    # Written, so that its small size is known and the join needs no shuffle of a hot stratum.
    judged = measured.join(persist_table(_cuts(thresholds(measured, labels)), "quality-cuts"), "stratum", "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        _reasons(lambda f: F.col(f)).alias("reasons"),
    ).withColumn("kept", F.size("reasons") == 0)


def _cuts(cut: DataFrame) -> DataFrame:
    """One row a stratum with its cutoffs as a map; few rows, joined by Spark's own choice of strategy."""
    return cut.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("feature", "cutoff"))).alias("cuts"))


def _reasons(value, cuts: str = "cuts") -> Column:
    return F.array_compact(
        F.array(
            F.when(value("base_failed"), F.lit("base")),
            *(F.when(value(f) > F.try_element_at(cuts, F.lit(f)), F.lit(f)) for f in FEATURES),
        )
    )


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_verdicts` keeps, with all their columns.

    The counts are worked out once and written beside each row, so nothing is
    joined back but the cutoffs of a stratum.  Rows without doc_id or with a
    repeated one are judged each; an empty table gives no rows.
    """
    mine = "loomstone_quality"
    while mine in docs.columns:
        mine += "_"
    has = {c.lower() for c in docs.columns}
    own = lambda name, kind: (F.col(f"`{name}`") if name.lower() in has else F.lit(None)).cast(kind)
    facts = let(
        _facts(F.coalesce(own("text", "string"), F.lit(""))),
        lambda f: F.struct(
            own("doc_id", "bigint").alias("doc_id"), F.coalesce(own(stratum, "string"), F.lit("")).alias("stratum"),
            *(f[n].alias(n) for n in [*COUNTS, "base_failed", *FEATURES, "digest"]),
        ),
    )
    measured = persist_table(docs.withColumn(mine, facts), "quality-measured")
    cuts = persist_table(_cuts(thresholds(measured.select(f"{mine}.*"), labels)), "quality-cuts")
    cuts = cuts.select(F.col("stratum").alias(f"{mine}_stratum"), F.col("cuts").alias(f"{mine}_cuts"))
    judged = measured.join(cuts, F.col(f"{mine}.stratum") == F.col(f"{mine}_stratum"), "left")
    good = F.size(_reasons(lambda n: F.col(f"{mine}.{n}"), f"{mine}_cuts")) == 0
    return judged.filter(good).select(*(F.col(f"`{c}`") for c in docs.columns))
