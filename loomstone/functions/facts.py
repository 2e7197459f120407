"""Facts of a page: links, metadata, base URL, JSON-LD product data."""

from __future__ import annotations

import json
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from loomstone.functions.html_tree import Tree
from loomstone.functions.urls import TRACKING

#: Meta names that are kept.
META = ["description", "og:title", "og:description", "og:image", "og:type", "og:url", "twitter:title", "twitter:description"]


def canonical_url(url: str, base: str = "") -> str:
    """Absolute URL with lower-case IDNA host, no default port, no fragment, stable query; other schemes unchanged."""
    whole = urljoin(base, url.strip())
    try:
        p = urlsplit(whole)
        port = p.port
    except ValueError:
        return whole
    name = (p.hostname or "").rstrip(".")
    if p.scheme not in ("http", "https") or not name:
        return whole
    try:
        name = name.encode("idna").decode()
    except UnicodeError:
        pass
    name = f"[{name}]" if ":" in name else name
    if port not in (None, 80 if p.scheme == "http" else 443):
        name += f":{port}"
    kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in TRACKING and not k.lower().startswith("utm_")]
    return urlunsplit((p.scheme, name, p.path or "/", urlencode(sorted(kept)), ""))


def base_url(tree: Tree, url: str) -> str:
    """What relative links are relative to: the first http(s) base element before the body, else the page."""
    for i in tree.elements():
        if tree.tag[i] == "body":
            break
        if tree.tag[i] == "base" and tree.get(i, "href"):
            base = urljoin(url, tree.get(i, "href").strip())
            return base if base.startswith(("http://", "https://")) else url
    return url


def facts(tree: Tree, url: str) -> tuple[list[str], dict[str, str]]:
    """(sorted distinct links, metadata)."""
    base, links, meta, docs = base_url(tree, url), set(), {}, []
    for i in tree.elements():
        tag = tree.tag[i]
        if tag == "a" and tree.get(i, "href"):
            links.add(canonical_url(tree.get(i, "href"), base))
        elif tag == "html" and tree.get(i, "lang").strip():
            meta.setdefault("language", tree.get(i, "lang").strip())
        elif tag == "title":
            meta.setdefault("title", " ".join(" ".join(tree.text[i + 1 : tree.end[i]]).split()))
        elif tag == "link" and "canonical" in tree.get(i, "rel").lower() and tree.get(i, "href"):
            meta["canonical"] = canonical_url(tree.get(i, "href"), base)
        elif tag == "meta" and tree.get(i, "content"):
            name = (tree.get(i, "name") or tree.get(i, "property")).lower()
            if name in META:
                meta[name] = tree.get(i, "content").strip()
        elif tag == "script" and tree.get(i, "type").lower() == "application/ld+json":
            try:
                docs.append(json.loads("".join(tree.text[i + 1 : tree.end[i]])))
            except ValueError:
                pass
    links.discard("")
    return sorted(links), {k: v for k, v in meta.items() if v} | product(docs)


_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.IGNORECASE | re.DOTALL | re.ASCII)


def title_source(tree: Tree, html: str) -> str:
    """The first title as it is written, with its character references; empty if there is none or it has no end."""
    if not tree.title_at:
        return ""
    line, column = tree.title_at
    at = 0
    for _ in range(line - 1):
        at = html.index("\n", at) + 1
    found = _TITLE.match(html, at + column)
    return found[1] if found else ""


def _nodes(value):
    """JSON-LD nodes, a graph's before its container."""
    if isinstance(value, list):
        for x in value:
            yield from _nodes(x)
    elif isinstance(value, dict):
        if isinstance(value.get("@graph"), list):
            yield from _nodes(value["@graph"])
        yield value


def _kinds(node: dict) -> list[str]:
    kind = node.get("@type")
    return [kind] if isinstance(kind, str) else [k for k in kind if isinstance(k, str)] if isinstance(kind, list) else []


def product(docs: list) -> dict[str, str]:
    """Counts and types of JSON-LD nodes, and the first product with its first offer."""
    nodes = list(_nodes(docs))
    if not nodes:
        return {}
    out = {"jsonld_count": str(len(nodes))}
    if kinds := sorted({k for n in nodes for k in _kinds(n)}):
        out["schema_types"] = ",".join(kinds)
    found = next((n for n in nodes if "Product" in _kinds(n)), {})
    offers = found.get("offers")
    offer = (offers[0] if offers else {}) if isinstance(offers, list) else offers
    as_dict = lambda x: x if isinstance(x, dict) else {}
    wanted = {
        "product_name": found.get("name"), "product_sku": found.get("sku"), "product_brand": as_dict(found.get("brand")).get("name"),
        "product_price": as_dict(offer).get("price"), "product_currency": as_dict(offer).get("priceCurrency"),
        "product_availability": as_dict(offer).get("availability"), "product_rating_value": as_dict(found.get("aggregateRating")).get("ratingValue"),
        "product_review_count": as_dict(found.get("aggregateRating")).get("reviewCount"),
    }
    for k, v in wanted.items():
        if isinstance(v, str | int | float) and (s := str(v).strip()):
            out[k] = re.sub(r"^.*/", "", s) if k == "product_availability" else s
    return out
