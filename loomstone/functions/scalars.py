"""Small columns: numbers in text, cache keys, fences, table cells, summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """The first number of a text as a double; of comma and point the last is the decimal mark.

    A lone comma before three figures groups, several points group; null if there is no number.
    """
    raw = F.regexp_replace(F.regexp_extract(text, r"(-?\d[\d.,\s]*)", 1), r"\s", "")
    d = F.regexp_replace(raw, r"[.,]+$", "")
    comma, point = F.length(d) - F.instr(F.reverse(d), ","), F.length(d) - F.instr(F.reverse(d), ".")
    has = lambda c: F.instr(d, c) > 0
    no = lambda x, c: F.replace(x, F.lit(c), F.lit(""))
    tail = F.substring_index(d, ",", -1)
    head = F.substring(d, F.lit(1), F.length(d) - F.length(tail) - 1)
    plain = (
        F.when(has(",") & has("."), F.when(comma > point, F.replace(no(d, "."), F.lit(","), F.lit("."))).otherwise(no(d, ",")))
        .when(has(","), F.when(F.length(tail) == 3, no(d, ",")).otherwise(F.concat(no(head, ","), F.lit("."), tail)))
        .when(F.length(d) - F.length(no(d, ".")) > 1, no(d, "."))
        .otherwise(d)
    )
    return plain.try_cast("double")


def cache_key(**parts: Column) -> Column:
    """sha256 over named parts in the order of their names; nulls and empty texts differ."""
    return F.sha2(F.to_json(F.struct(*(parts[n].alias(n) for n in sorted(parts))), {"ignoreNullFields": "false"}), 256)


def cell(text: Column, most: int = 500) -> Column:
    """A table cell: one line, bars escaped, cut with an ellipsis."""
    line = F.replace(F.btrim(F.regexp_replace(text, r"[\r\n]+", " ")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def structure_errors(md: Column) -> Column:
    """Faults of a Markdown text: an open fence, table lines without a rule."""
    lines = F.split(md, "\n")
    fences = F.size(F.filter(lines, lambda x: F.btrim(x).startswith("```")))
    bars = F.size(F.filter(lines, lambda x: F.btrim(x).startswith("|")))
    return (fences % 2) + F.when((bars > 0) & ~F.contains(md, F.lit("---")), 1).otherwise(0)


def in_fence(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """``lines`` with a column fenced: whether a line lies inside or on a code fence."""
    mark = F.btrim(F.col(text)).startswith("```").cast("int")
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("fenced", (F.sum(mark).over(w) % 2 == 1) | (mark == 1))


def section_ends(headings: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """``headings`` with stop: the place of the next heading of the same or a higher level, null at the end.

    For each level of six one running minimum from behind; no self join.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = headings
    for n in range(1, 7):
        out = out.withColumn(f"_next{n}", F.last(F.when(F.col(level) <= n, F.col(order)), ignorenulls=True).over(w))
    stop = None
    for n in range(1, 7):
        c = F.col(f"_next{n}")
        stop = F.when(F.col(level) == n, c) if stop is None else stop.when(F.col(level) == n, c)
    return out.withColumn("stop", stop).drop(*(f"_next{n}" for n in range(1, 7)))


def not_modified(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """``requests`` (url, etag) with not_modified: the stored version carries the same tag."""
    old = stored.select(F.col("url").alias("_u"), F.col("etag").alias("_e"))
    return requests.join(old, F.col("url") == F.col("_u"), "left").withColumn("not_modified", F.coalesce(F.col("_e") == F.col("etag"), F.lit(False))).drop("_u", "_e")


def first_success(attempts: DataFrame, key: str, priority: str, ok: str) -> DataFrame:
    """The successful attempt with the smallest priority for each key, else the last attempt."""
    w = Window.partitionBy(key).orderBy(F.col(ok).desc(), F.when(F.col(ok), F.col(priority)).otherwise(-F.col(priority)))
    return attempts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def run_metrics(pages: DataFrame) -> DataFrame:
    """One row over crawled pages (status, retries): visited, failed, pending, retries, all_failed."""
    return pages.agg(
        F.count_if(F.col("status") == "ok").alias("visited"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("pending"), F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("retries"),
        F.coalesce(F.bool_and(F.col("status") == "failed"), F.lit(False)).alias("all_failed"),
    )
