"""Column helpers for the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as a character class body (fixed value).
WS = r"\x20\x09-\x0D"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value worked out once, however often and in whatever lambda body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """The words between separators (a character class body), none of them empty."""
    return F.filter(F.split(text, f"[{separators}]+"), lambda w: w != "")


#: Folds that give an array work in runs of this many values.
RUN = 32
_WORD = f"[^{WS}]++"


def scan(
    values: Column, zero: Column, advance: Callable[[Column, Column], Column], item: Callable[[Column, Column], Column], kind: str
) -> Column:
    """The items of a fold over ``values``: item(state, value), where it is not null, before each advance(state, value).

    zero: the first state.  kind: the type of the resulting array.  A fold copies
    its state at each step, so a first one keeps only the states at which runs of
    values begin, and the runs are gone through each on its own: work grows with
    n + (n / RUN)^2 small copies, not with n^2 large ones.
    """

    def runs(bound: Column) -> Column:
        def values_of(k: Column) -> Column:
            places = F.sequence(k * RUN, F.least((k + 1) * RUN, F.size(bound)) - 1)
            return F.transform(places, lambda i: F.get(bound, i))  # a slice would copy the whole array

        def begin(acc: Column, k: Column) -> Column:
            return F.struct(
                F.aggregate(values_of(k), acc["state"], advance).alias("state"),
                F.concat(acc["past"], F.array(acc["state"])).alias("past"),
            )

        def one(state: Column, k: Column) -> Column:
            grown = lambda acc, made: F.when(made.isNotNull(), F.concat(acc["items"], F.array(made).cast(kind))).otherwise(acc["items"])
            step = lambda acc, value: F.struct(
                advance(acc["state"], value).alias("state"), grown(acc, item(acc["state"], value)).alias("items")
            )
            start = F.struct(state.alias("state"), F.array().cast(kind).alias("items"))
            return F.aggregate(values_of(k), start, step, lambda acc: acc["items"])

        count = F.ceil(F.size(bound) / RUN).cast("int")
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        none = F.filter(F.array(zero), lambda x: F.lit(False))
        begun = F.aggregate(places, F.struct(zero.alias("state"), none.alias("past")), begin, lambda acc: acc["past"])
        return F.flatten(F.transform(begun, one))

    return let(values, runs)


def matches(
    text: Column,
    pattern: str,
    gate: Column | str | None = None,
    keep: Callable[[Column], Column] | None = None,
    words: bool = False,
) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>> in code points, end exclusive.

    The text is cut at its matches, and a fold over (gap, match) adds the
    lengths, so no position is searched twice.  gate: a condition, or a pattern,
    that every text with a kept match meets, for skipping the rest.  keep: which
    values to keep.  words: also ``first`` and ``last``, the indices of the words
    (parts without ASCII white space) in which the match begins and ends.
    """
    kind = "array<struct<start:int,end:int,value:string" + (",first:int,last:int>>" if words else ">>")
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    pairs = F.transform(pairs, lambda p: F.struct(p["gap"].alias("gap"), F.coalesce(p["hit"], F.lit("")).alias("hit")))

    def passed(state: Column, part: Column) -> Column:
        """The state behind one more part of the text: length, words begun, and 1 if one is open."""
        begun = F.regexp_count(F.concat(F.when(state["open"] == 1, "x").otherwise(""), part), F.lit(_WORD))
        last = F.when(part == "", state["open"]).otherwise(part.rlike(rf"[^{WS}]\z").cast("int"))
        more = [(state["begun"] + begun - state["open"]).alias("begun"), last.alias("open")] if words else []
        return F.struct((state["at"] + F.length(part)).alias("at"), *more)

    def item(state: Column, pair: Column) -> Column:
        def span(before: Column, after: Column) -> Column:
            more = [(before["begun"] - before["open"]).alias("first"), (after["begun"] - 1).alias("last")] if words else []
            return F.struct(before["at"].alias("start"), after["at"].alias("end"), pair["hit"].alias("value"), *more)

        good = (pair["hit"] != "") & (F.coalesce(keep(pair["hit"]), F.lit(False)) if keep else F.lit(True))
        made = let(passed(state, pair["gap"]), lambda b: let(passed(b, pair["hit"]), lambda a: span(b, a)))
        return F.when(good, made)

    def advance(state: Column, pair: Column) -> Column:
        return let(passed(state, pair["gap"]), lambda b: passed(b, pair["hit"]))

    zero = F.struct(F.lit(0).alias("at"), *([F.lit(0).alias("begun"), F.lit(0).alias("open")] if words else []))
    found = scan(pairs, zero, advance, item, kind)
    if gate is None or isinstance(gate, str):
        gate = text.rlike(gate or pattern)
    return F.when(gate, found).otherwise(F.array().cast(kind))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with its spans, array<struct<start, end, mark>>, replaced by their marks.

    Spans that overlap are taken out as one, with the mark of the first.  The
    text is cut into runs of pieces before it is cut into pieces, since each cut
    counts characters from the start of what it cuts.
    """
    piece = lambda a, b, mark: F.struct(a.alias("from"), b.alias("to"), mark.alias("mark"))
    kind = "array<struct<from:int,to:int,mark:string>>"

    def pieces(order: Column) -> Column:
        before = scan(
            order,
            F.lit(0),
            lambda at, s: F.greatest(at, s["end"]),
            lambda at, s: F.when(s["start"] >= at, piece(at, s["start"], s["mark"])),
            kind,
        )
        rest = piece(F.array_max(F.transform(order, lambda s: s["end"])), F.length(text), F.lit(""))
        return F.concat(before, F.array(rest).cast(kind))

    def run(ps: Column, k: Column) -> Column:
        mine = F.transform(F.sequence(k * RUN, F.least((k + 1) * RUN, F.size(ps)) - 1), lambda i: F.get(ps, i))
        low, high = F.get(ps, k * RUN)["from"], F.get(ps, F.least((k + 1) * RUN, F.size(ps)) - 1)["to"]
        cut = lambda part: F.transform(
            mine, lambda p: F.concat(F.substring(part, p["from"] - low + 1, p["to"] - p["from"]), p["mark"])
        )
        return F.array_join(let(F.substring(text, low + 1, high - low), cut), "")

    def whole(ps: Column) -> Column:
        count = F.ceil(F.size(ps) / RUN).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda k: run(ps, k)), "")

    return F.when(F.size(spans) > 0, let(let(F.array_sort(spans), pieces), whole)).otherwise(text)


def joined(kinds: list[tuple[str, Column]], by_start: bool) -> Column:
    """kind:start:end of all spans, comma-joined: by start then kind as listed, or by kind then start."""

    def keyed(k: int, name: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            (s["start"] if by_start else F.lit(k)).alias("a"),
            (F.lit(k) if by_start else s["start"]).alias("b"),
            s["end"].alias("c"),
            F.concat(F.lit(name + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")).alias("d"),
        )

    rows = [F.transform(spans, keyed(k, name)) for k, (name, spans) in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*rows)), lambda r: r["d"]), ",")
