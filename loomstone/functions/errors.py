"""Columns over error messages and run metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.urls import redact_credentials

# The first rule whose words occur decides.
RULES = [
    ("local_files_disabled", ["local file sources are disabled"]),
    ("local_file_outside_root", ["local file sources must stay inside"]),
    ("network_error", ["tunnel connection failed", "proxyerror", "proxy error"]),
    ("blocked", ["http error 403", "forbidden"]),
    ("rate_limited", ["http error 429", "too many requests"]),
    ("not_found", ["http error 404", "not found"]),
    ("timeout", ["timed out", "timeout"]),
    ("tls_error", ["ssl", "certificate", "err_cert_"]),
    ("network_error", ["name or service not known", "temporary failure", "connection"]),
    ("browser_error", ["playwright", "browser", "chromium"]),
]
# Status codes with a class of their own.
STATUS = {403: "blocked", 404: "not_found", 410: "not_found", 429: "rate_limited"}
MAX_CHARS = 300


def classify(message: Column) -> Column:
    """The error class of a message; null for none."""
    text = F.lower(message)
    out = None
    for name, needles in RULES:
        hit = F.lit(False)
        for n in needles:
            hit = hit | text.contains(n)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(F.coalesce(message, F.lit("")) != "", out.otherwise("fetch_error"))


def classify_failure(explicit: Column, status: Column, message: Column) -> Column:
    """An explicit class, else that of the status, else that of the message."""
    by_status = F.when(status.isNull(), F.lit(None))
    for code, name in STATUS.items():
        by_status = by_status.when(status == code, name)
    explicit = F.when(explicit != "", explicit)
    return F.coalesce(explicit, by_status.otherwise("fetch_error"), classify(message), F.lit("fetch_error"))


def sanitize(message: Column, limit: int = MAX_CHARS) -> Column:
    """One line without control characters and credentials, cut with an ellipsis."""
    text = F.regexp_replace(F.coalesce(message, F.lit("")), r"[\x00-\x1F\x7F]", " ")
    text = redact_credentials(F.btrim(F.regexp_replace(text, r"(?U)\s+", " ")))
    short = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(text) > limit, short).otherwise(text)


def coverage(error_type: Column, n_errors: Column, flags: dict[str, Column], chars: Column) -> Column:
    """Struct of status and reasons: whether a result is the whole page.

    flags: boolean columns javascript_required, browser_render_error,
    network_idle_timeout, markdown_truncated, api_truncated; missing ones are false.
    """
    on = lambda key, reason: F.when(F.coalesce(flags.get(key, F.lit(False)), F.lit(False)), F.lit(reason))
    partial = F.array_compact(
        F.array(
            on("javascript_required", "needs_javascript"), on("browser_render_error", "browser_render_failed"),
            on("network_idle_timeout", "network_still_busy"), F.when(chars == 0, F.lit("empty_page")),
        )
    )
    cut = F.array_compact(F.array(on("markdown_truncated", "token_budget"), on("api_truncated", "api_endpoint_limit")))
    kind = F.coalesce(F.when(error_type != "", error_type), F.lit("fetch_error"))
    failed = (F.coalesce(error_type, F.lit("")) != "") | (F.coalesce(n_errors, F.lit(0)) > 0)
    status = (
        F.when(failed & kind.isin("client_challenge", "blocked"), "blocked").when(failed, "failed")
        .when(F.size(partial) > 0, "partial").when(F.size(cut) > 0, "truncated").otherwise("complete")
    )
    return F.struct(status.alias("status"), F.when(failed, F.array(kind)).otherwise(F.concat(partial, cut)).alias("reasons"))


def crawl_delay(base: float, attempt: Column, most: float) -> Column:
    """Doubling delay of a crawl retry, bounded."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def http_delay(retry_after: Column, base: float, attempt: Column) -> Column:
    """What the server asked for, between 0 and 30 seconds, else a doubling delay of at most 10."""
    asked = retry_after.try_cast("double")
    return F.coalesce(F.least(F.greatest(asked, F.lit(0.0)), F.lit(30.0)), F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(10.0)))


#: What to do after an error of each type (the types are fixed values).
NEXT_STEPS = {
    "client_challenge": "The site asks for proof that a person is there; asking again as is will not help.",
    "blocked": "The site refuses this client; another address or a saved login may be let in.",
    "rate_limited": "Too many requests; wait, or go more slowly.",
    "timeout": "The site was too slow; try once more, or allow more time.",
    "not_found": "There is no such page; check the URL.",
    "tls_error": "The site's certificate is not valid, so the page cannot be trusted.",
    "network_error": "The site cannot be reached; check the host, or try later.",
    "section_not_found": "The page has no such section; choose one of its outline.",
    "browser_error": "The browser failed on the page; try once more, or without one.",
}


def next_step(error_type: Column) -> Column:
    """What to do after an error; null for no error and for types that have no advice."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in NEXT_STEPS.items() for x in pair)), error_type)
