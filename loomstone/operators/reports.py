"""Summaries of runs, and what leaves the engine: JSON rows, failure files, event logs, a dashboard page."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each smoke check may get when it expects a bot challenge (fixed values).
CHALLENGES = ["client_challenge", "blocked"]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def change_counts(changes: DataFrame, change: str = "change") -> DataFrame:
    """One row: how many pages are new, changed and unchanged."""
    return changes.agg(*(F.count_if(F.col(change) == c).alias(c) for c in ("new", "changed", "unchanged")))


def batch_summary(results: DataFrame, error: str = "error") -> DataFrame:
    """One row: total, succeeded and failed pages of a batch; a page with an error failed."""
    failed = F.count_if(F.col(error).isNotNull())
    return results.agg(F.count("*").alias("total"), (F.count("*") - failed).alias("succeeded"), failed.alias("failed"))


def dashboard_totals(**parts: DataFrame) -> DataFrame:
    """(metric, value): the sums of all numeric columns of each named summary, as ``name.column``.

    Every part is summed on its own and gives one row for each column, so nothing is joined.
    """
    out = None
    for name in sorted(parts):
        df = parts[name]
        numeric = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
        sums = df.agg(*(F.coalesce(F.sum(f"`{c}`"), F.lit(0)).cast("double").alias(c) for c in numeric))
        rows = sums.select(
            F.explode(F.array(*(F.struct(F.lit(f"{name}.{c}").alias("metric"), F.col(f"`{c}`").alias("value")) for c in numeric))).alias("r")
        ).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def dashboard_page(totals: DataFrame, title: str = "Totals") -> str:
    """A static HTML page of (metric, value) rows, values escaped; the rows are as many as there are metrics."""
    show = lambda v: f"{v:g}" if isinstance(v, float) else str(v)
    rows = sorted((str(r["metric"]), show(r["value"])) for r in totals.select("metric", "value").collect())
    cells = "".join(f"<tr><th>{html.escape(m)}</th><td>{html.escape(v)}</td></tr>" for m, v in rows)
    name = html.escape(title)
    return f"<!doctype html><html><head><meta charset=utf-8><title>{name}</title></head><body><h1>{name}</h1><table>{cells}</table></body></html>"


def web_report(results: DataFrame, stratum: str, tool: str = "tool", bucket: str = "bucket") -> DataFrame:
    """Per tool and stratum, and per tool over all (stratum null): pages, junk, failed, thin, content, rate, median tokens and seconds.

    results: bucket of each page, tokens, seconds.  ``rate`` is the share of content; medians are exact.
    """
    counts = [F.count_if(F.col(bucket) == b).alias(b) for b in ("junk", "failed", "thin", "content")]
    return results.rollup(tool, stratum).agg(
        F.count("*").alias("pages"), *counts, _share(F.count_if(F.col(bucket) == "content"), F.count("*")).alias("rate"),
        F.median("tokens").alias("median_tokens"), F.median("seconds").alias("median_seconds"),
    ).filter(F.col(tool).isNotNull())


def quality_summary(scores: DataFrame, least: float, score: str = "score") -> DataFrame:
    """One row: mean score, and how many reach ``least`` and how many do not; no rows give a null mean."""
    return scores.agg(
        F.avg(score).alias("average"), F.count_if(F.col(score) >= least).alias("passed"), F.count_if(F.col(score) < least).alias("failed")
    )


def live_quality(results: DataFrame, tool: str = "tool") -> DataFrame:
    """Per tool: pages, mean recall, mean noise, and mean quality, which is recall * (1 - noise)."""
    return results.groupBy(tool).agg(
        F.count("*").alias("pages"), F.avg("recall").alias("recall"), F.avg("noise").alias("noise"),
        F.avg(F.col("recall") * (1 - F.col("noise"))).alias("quality"),
    )


def quality_signs(results: DataFrame, page: str = "page_id", tool: str = "tool") -> DataFrame:
    """(first, second, better, worse): on how many pages the first tool's quality is above or below the second's, first < second by name."""
    quality = (F.col("recall") * (1 - F.col("noise"))).alias("q")
    rows = results.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(tool).alias("t"), quality))).alias("all"))
    # A page has one row for each tool, so its list is short; pairs are made within it.
    pair = F.transform(
        "all",
        lambda a, i: F.transform(
            F.slice("all", i + 2, F.size("all")), lambda b: F.struct(a["t"].alias("first"), b["t"].alias("second"), F.signum(a["q"] - b["q"]).alias("sign"))
        ),
    )
    each = rows.select(F.explode(F.flatten(pair)).alias("p")).select("p.*")
    return each.groupBy("first", "second").agg(F.count_if(F.col("sign") > 0).alias("better"), F.count_if(F.col("sign") < 0).alias("worse"))


def smoke_reasons(markdown: Column, error_type: Column, expect: Column, must_contain: Column, min_chars: Column) -> Column:
    """Why a smoke check fails, array<string>, empty if it passes.

    A check that expects a challenge needs such an error.  Others need no error,
    ``min_chars`` characters (500 where null) and every text of ``must_contain`` in any case.
    """
    md = F.coalesce(markdown, F.lit(""))
    low = F.lower(md)
    absent = F.filter(F.coalesce(must_contain, F.array().cast("array<string>")), lambda t: ~F.contains(low, F.lower(t)))
    got = F.coalesce(error_type, F.lit("content"))
    content = F.array_compact(
        F.array(
            F.when(error_type.isNotNull(), F.concat(F.lit("error "), error_type)),
            F.when(F.length(md) < F.coalesce(min_chars, F.lit(500)), F.concat(F.lit("only "), F.length(md).cast("string"), F.lit(" chars"))),
            F.when(F.size(absent) > 0, F.concat(F.lit("missing "), F.array_join(absent, ", "))),
        )
    )
    challenged = F.when(got.isin(CHALLENGES), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("expected a challenge, got "), got)))
    return F.when(expect == "challenge", challenged).otherwise(content)


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as a JSON object with all its fields, nulls kept."""
    return df.select(F.col(f"`{key}`"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_failures(failures: DataFrame, path: str) -> bool:
    """Failures as CSV with a header; nothing is written, and False returned, where there are none."""
    if failures.isEmpty():
        return False
    failures.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
    return True


def append_events(events: DataFrame, path: str) -> None:
    """Add event or usage rows to a log; readers see whole appends only, by Spark's commit protocol."""
    events.write.mode("append").parquet(path)


def records(pages: DataFrame, by_chunk: bool = False) -> tuple[DataFrame, DataFrame]:
    """Text records for other frameworks, and the pages left out.

    pages: url, title, markdown, error, chunks array<struct<text, heading, cite_url>>.
    Records are (text, metadata map<string,string>), one a page or one a chunk;
    pages with an error or without text go to the second frame, (url, reason).
    """
    empty = F.coalesce(F.btrim("markdown"), F.lit("")) == ""
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(empty, F.lit("empty page"))
    good = pages.filter(reason.isNull())
    flat = lambda **c: F.map_filter(F.create_map(*(x for k, v in c.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    if by_chunk:
        each = good.select("url", "title", F.explode("chunks").alias("c"))
        out = each.select(F.col("c.text").alias("text"), flat(source=F.col("c.cite_url"), url=F.col("url"), title=F.col("title"), heading=F.col("c.heading")).alias("metadata"))
    else:
        out = good.select(F.col("markdown").alias("text"), flat(source=F.col("url"), url=F.col("url"), title=F.col("title")).alias("metadata"))
    return out, pages.filter(reason.isNotNull()).select("url", reason.alias("reason"))
