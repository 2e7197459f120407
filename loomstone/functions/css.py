"""Structured extraction by CSS selectors: selectors, extraction schemas, typed results."""

from __future__ import annotations

import json
import re
from typing import Any
from urllib.parse import urljoin

import regex

from loomstone.functions.html_tree import Tree

_SIMPLE = re.compile(
    r"(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|"
    r"\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]|"
    r":(?P<pseudo>first-child|last-child|nth-child|nth-of-type)(?:\(\s*(?P<n>\d+)\s*\))?"
)
#: A regular expression field may take this long.
REGEX_SECONDS = 0.05
MAX_DEPTH = 8
TYPES = ("text", "attribute", "html", "regex", "nested", "list")
TRANSFORMS = ("strip", "lower", "upper", "number", "url")


def compile_selector(text: str) -> list[list[tuple[str, list[dict]]]]:
    """Groups of (combinator, tests) from the rightmost part on; ValueError for anything unknown."""
    groups = []
    for part in text.split(","):
        steps, at, link = [], 0, " "
        part = part.strip()
        if not part:
            raise ValueError(f"empty selector in {text!r}")
        while at < len(part):
            if m := re.compile(r"\s*([>+~])\s*|\s+").match(part, at):
                if not steps:
                    raise ValueError(f"{text!r} begins with a combinator")
                link, at = m[1] or " ", m.end()
                continue
            tests = []
            while at < len(part) and (m := _SIMPLE.match(part, at)):
                if m["tag"] and tests:
                    raise ValueError(f"a tag must come first in {text!r}")
                if (m["pseudo"] or "").startswith("nth") != (m["n"] is not None):
                    raise ValueError(f"{m[0]!r} in {text!r} is not supported")
                tests.append(m.groupdict())
                at = m.end()
            if not tests:
                raise ValueError(f"{part[at:]!r} in {text!r} is not supported")
            steps.append((link, tests))
            link = ""
        if link:
            raise ValueError(f"{text!r} ends with a combinator")
        groups.append(steps[::-1])
    return groups


def _holds(t: Tree, i: int, test: dict) -> bool:
    if test["tag"]:
        return test["tag"] in ("*", t.tag[i])
    if test["id"]:
        return t.get(i, "id") == test["id"]
    if test["class"]:
        return test["class"] in t.get(i, "class").split()
    if test["name"]:
        name, op = test["name"].lower(), test["op"]
        if name not in t.attrs[i]:
            return False
        if not op:
            return True
        have, want = t.get(i, name), test["value"].strip("\"'")
        return {
            "=": have == want, "~=": want in have.split(), "^=": bool(want) and have.startswith(want),
            "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have,
        }[op]
    same = [j for j in t.children(t.parent[i]) if t.tag[j] is not None]
    if test["pseudo"] == "nth-of-type":
        same = [j for j in same if t.tag[j] == t.tag[i]]
    place = same.index(i) + 1
    return place == {"first-child": 1, "last-child": len(same)}.get(test["pseudo"], int(test["n"] or 0))


def _matches(t: Tree, i: int, steps: list, scope: int) -> bool:
    link, tests = steps[0]
    if not all(_holds(t, i, x) for x in tests):
        return False
    if len(steps) == 1:
        return True
    up = t.parent[i]
    if link == ">":
        return up > scope and _matches(t, up, steps[1:], scope)
    if link == " ":
        while up > scope:
            if _matches(t, up, steps[1:], scope):
                return True
            up = t.parent[up]
        return False
    before = [j for j in t.children(up) if t.tag[j] is not None and j < i]
    near = before[-1:] if link == "+" else before
    return any(_matches(t, j, steps[1:], scope) for j in near)


def select(t: Tree, selector: str | list, scope: int = 0) -> list[int]:
    """Elements strictly inside ``scope`` that match, in document order."""
    groups = compile_selector(selector) if isinstance(selector, str) else selector
    return [i for i in t.elements(scope) if any(_matches(t, i, g, scope) for g in groups)]


def number(value: str) -> float | None:
    """The first number of a text; of comma and point the last is the decimal mark, a comma before three digits groups."""
    m = re.search(r"-?\d[\d.,\s]*", value)
    if not m:
        return None
    s = re.sub(r"\s", "", m[0]).rstrip(".,")
    comma, point = s.rfind(","), s.rfind(".")
    if comma >= 0 and point >= 0:
        s = s.replace(".", "").replace(",", ".") if comma > point else s.replace(",", "")
    elif comma >= 0:
        s = s.replace(",", "") if len(s) - comma - 1 == 3 else s[:comma].replace(",", "") + "." + s[comma + 1 :]
    elif s.count(".") > 1:
        s = s.replace(".", "")
    try:
        return float(s)
    except ValueError:
        return None


def check_schema(schema: dict, depth: int = 0) -> dict:
    """Raise ValueError for an extraction schema that cannot work."""
    if depth > MAX_DEPTH:
        raise ValueError(f"a schema may nest {MAX_DEPTH} deep")
    fields = schema.get("fields")
    if not isinstance(fields, list) or not fields:
        raise ValueError("a schema needs fields")
    names = [f.get("name") for f in fields]
    if len(set(names)) < len(names) or not all(isinstance(n, str) and n for n in names):
        raise ValueError("field names must be different and not empty")
    if schema.get("baseSelector"):
        compile_selector(schema["baseSelector"])
    for f in fields:
        kind = f.get("type", "text")
        if kind not in TYPES:
            raise ValueError(f"unknown type {kind!r} of {f['name']}")
        if f.get("transform") not in (None, *TRANSFORMS):
            raise ValueError(f"unknown transform {f['transform']!r} of {f['name']}")
        if f.get("selector"):
            compile_selector(f["selector"])
        if kind == "attribute" and not f.get("attribute"):
            raise ValueError(f"{f['name']} needs an attribute")
        if kind == "regex":
            try:
                regex.compile(f.get("pattern") or "")
            except regex.error as e:
                raise ValueError(f"{f['name']}: {e}") from e
        if kind in ("nested", "list"):
            check_schema(f, depth + 1)
    return schema


def spark_type(schema: dict) -> str:
    """The result's DDL type, derived from the schema."""

    def field(f: dict) -> str:
        kind = f.get("type", "text")
        if kind in ("nested", "list"):
            inner = "struct<" + ",".join(f"`{x['name']}`:{field(x)}" for x in f["fields"]) + ">"
            return f"array<{inner}>" if kind == "list" else inner
        base = "double" if f.get("transform") == "number" else "string"
        return f"array<{base}>" if f.get("multiple") else base

    return "struct<" + ",".join(f"`{f['name']}`:{field(f)}" for f in schema["fields"]) + ">"


def _text(t: Tree, i: int) -> str:
    return t.string(i)


def _value(t: Tree, i: int, f: dict, base: str) -> Any:
    kind = f.get("type", "text")
    if kind == "attribute":
        raw = t.get(i, f["attribute"].lower())
    elif kind == "html":
        raw = outer_html(t, i)
    elif kind == "regex":
        try:
            m = regex.search(f["pattern"], _text(t, i), timeout=REGEX_SECONDS)
        except TimeoutError:
            m = None
        raw = (m[1] if m.re.groups else m[0]) if m else ""
    else:
        raw = _text(t, i)
    raw = (raw or "").strip()
    how = f.get("transform")
    if how == "number":
        return number(raw)
    return {"lower": raw.lower(), "upper": raw.upper(), "url": urljoin(base, raw) if raw else ""}.get(how, raw)


def _field(t: Tree, scope: int, f: dict, base: str) -> Any:
    kind = f.get("type", "text")
    found = select(t, f["selector"], scope) if f.get("selector") else [scope]
    if kind == "nested":
        return _object(t, found[0], f["fields"], base) if found else None
    if kind == "list":
        return [o for i in found if (o := _object(t, i, f["fields"], base))] or None
    values = [v for i in found if (v := _value(t, i, f, base)) not in (None, "")]
    if f.get("multiple"):
        return values or f.get("default")
    return values[0] if values else f.get("default")


def _object(t: Tree, scope: int, fields: list[dict], base: str) -> dict:
    out = {f["name"]: _field(t, scope, f, base) for f in fields}
    return {k: v for k, v in out.items() if v not in (None, "", [], {})}


def extract(html: str, schema: dict, base: str = "") -> list[dict]:
    """Objects of a page: one for each match of baseSelector, else one for the page; empty values are left out."""
    t = Tree(html or "")
    if not schema.get("baseSelector"):
        return [_object(t, 0, schema["fields"], base)]
    return [o for i in select(t, schema["baseSelector"]) if (o := _object(t, i, schema["fields"], base))]


def outer_html(t: Tree, i: int) -> str:
    import html

    out, stack = [], []
    for j in range(i, t.end[i]):
        while stack and j >= t.end[stack[-1]]:
            out.append(f"</{t.tag[stack.pop()]}>")
        if t.tag[j] is None:
            out.append(html.escape(t.text[j], quote=False))
        else:
            attrs = "".join(f' {k}="{html.escape(v)}"' if v is not None else f" {k}" for k, v in t.attrs[j].items())
            out.append(f"<{t.tag[j]}{attrs}>")
            if t.end[j] > j + 1 or t.tag[j] not in ("br", "img", "hr", "input", "meta", "link"):
                stack.append(j)
    out += [f"</{t.tag[s]}>" for s in reversed(stack)]
    return "".join(out)


def extract_records(pages, schema: dict, key: str = "page_id"):
    """A DataFrame of ``key``, idx and the schema's fields, a row for each object."""
    from pyspark.sql import functions as F

    check_schema(schema)
    kind = spark_type(schema)

    @F.udf(returnType="array<string>", useArrow=True)
    def run(html, url):
        return [json.dumps(o) for o in extract(html, schema, url or "")]

    rows = pages.select(key, F.posexplode(run("html", "url")).alias("idx", "record"))
    return rows.select(key, "idx", F.from_json("record", kind).alias("r")).select(key, "idx", "r.*")
