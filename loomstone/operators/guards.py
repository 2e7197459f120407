"""Address and host checks for what a crawl may reach, on literals only: nothing is looked up."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.urls import host, origin, part, port

MAX_URL = 8192


def url_shape_ok(url: Column) -> Column:
    """http(s), not too long, no user information, a host and a valid port."""
    return F.coalesce(
        (F.length(url) <= MAX_URL) & (host(url) != "") & ~url.rlike(r"(?i)^https?://[^/?#]*@") & ((part(url, 3) == "") | port(url).between(1, 65535)),
        F.lit(False),
    )


def is_global(address: str) -> bool:
    """Whether an address is public, also the one inside a mapped, NAT64 or 6to4 address."""
    try:
        a = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return False
    if isinstance(a, ipaddress.IPv6Address):
        inner = a.ipv4_mapped or a.sixtofour
        if a in ipaddress.ip_network("64:ff9b::/96"):
            inner = ipaddress.IPv4Address(int(a) & 0xFFFFFFFF)
        if inner is not None:
            return inner.is_global
    return a.is_global and not a.is_multicast


def addresses_ok(addresses: Column) -> Column:
    """Whether there are addresses and all of them are public; addresses: array<string>."""
    return F.udf(lambda xs: bool(xs) and all(is_global(x) for x in xs), "boolean", useArrow=True)(addresses)


def audit_summary(records: DataFrame) -> DataFrame:
    """One row: sent, third_party and blocked requests and all bytes; records: (bytes, third_party, blocked)."""
    return records.agg(
        F.count_if(~F.col("blocked")).alias("sent"), F.count_if("third_party").alias("third_party"), F.count_if("blocked").alias("blocked"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def product_token(agent: str, product: str) -> str:
    """The name that robots rules are matched with: ``product``, with its version where the user agent gives one."""
    m = re.search(rf"{re.escape(product)}(?:/[\d.]+)?", agent or "")
    return m[0] if m else product


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, rules, refused): each robots file read once; robots: (origin, status, body).

    rules: array<struct<allow, path>> that concern the agent, in the order of the
    file.  429, 5xx and no answer refuse everything; other 4xx have no rules.
    """
    from urllib.robotparser import RobotFileParser

    @F.udf("array<struct<allow:boolean,path:string>>", useArrow=True)
    def read(body: str | None) -> list[tuple[bool, str]]:
        parser = RobotFileParser()
        parser.parse((body or "").splitlines())
        mine = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
        return [(line.allowance, line.path) for line in mine.rulelines] if mine else []

    status = F.col("status")
    refused = status.isNull() | (status == 429) | (status >= 500)
    body = F.when(status.between(200, 399), F.col("body"))
    return robots.select("origin", read(body).alias("rules"), refused.alias("refused"))


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``pages`` (url, ...) with allowed, by the robots file of their origin; robots: (origin, status, body).

    The first rule whose path begins the page's path and query decides, and
    robots.txt itself is always allowed.  An origin that is not in ``robots`` allows all.
    """
    rules = robots_rules(robots, agent).select(origin(F.col("origin")).alias("_origin"), "rules", "refused")
    url = F.col("url")
    path = F.concat(F.when(part(url, 4) == "", "/").otherwise(part(url, 4)), F.when(part(url, 5) == "", "").otherwise(F.concat(F.lit("?"), part(url, 5))))
    hit = F.get(F.filter("rules", lambda r: (r["path"] == "*") | F.startswith(path, r["path"])), F.lit(0))
    verdict = F.when(path == "/robots.txt", True).when(F.col("refused"), False).otherwise(F.coalesce(hit["allow"], F.lit(True)))
    joined = pages.join(rules, origin(url) == F.col("_origin"), "left")
    return joined.withColumn("allowed", F.coalesce(verdict, F.lit(True))).drop("_origin", "rules", "refused")


def discovered_apis(calls: DataFrame, limit: int = 30) -> DataFrame:
    """Endpoints of observed calls (seq, method, url, shape): one for each method, origin, path and set of parameters.

    The first ``limit`` by first call, with their counts; secret parameters are redacted.
    """
    from loomstone.functions.urls import query_keys, redact_url, scheme

    u = F.col("url")
    key = calls.withColumns({"_s": scheme(u), "_h": host(u), "_p": part(u, 4), "_k": F.array_join(query_keys(part(u, 5)), "&")})
    return (
        key.groupBy("method", "_s", "_h", "_p", "_k")
        .agg(F.min("seq").alias("seq"), F.count("*").alias("calls"), F.min_by(redact_url(u), "seq").alias("url"), F.min_by("shape", "seq").alias("shape"))
        .orderBy("seq").limit(limit).select("seq", "method", "url", "shape", "calls")
    )
