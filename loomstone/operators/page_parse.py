"""Parsing pages: one pass over the HTML gives every output that was asked for."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomstone.functions.facts import base_url, facts, title_source
from loomstone.functions.content import Page
from loomstone.functions.html_tree import Tree
from loomstone.functions.markdown import render
from loomstone.functions.passages import chunks, outline

#: Output name -> its column type.
FORMATS = {
    "markdown": "string",
    "text_chars": "bigint",
    "links": "array<string>",
    "metadata": "map<string,string>",
    "title_source": "string",
    "provenance": "struct<strategy:string,hint:string,tag:string,id:string,classes:string,candidates:int,score:bigint,chars:bigint,sha256:string>",
    "chunks": "array<struct<id:int,text:string,heading:string,url:string,cite_url:string,estimated_tokens:int>>",
    "outline": "array<struct<id:string,heading:string,level:int,tokens:int>>",
}


def parse(html: str, url: str, wanted: list[str], main_only: bool = True, chunk_tokens: int = 400) -> dict:
    """The wanted outputs of a page; the tree is built once."""
    tree = Tree(html or "")
    page, out = Page(tree), {}
    md = None
    if {"markdown", "chunks", "outline"} & set(wanted):
        md = render(page, page.content(main_only), base_url(tree, url or ""))
        out["markdown"] = md
    if {"links", "metadata"} & set(wanted):
        out["links"], out["metadata"] = facts(tree, url or "")
    if "title_source" in wanted:
        out["title_source"] = None if html is None else title_source(tree, html)
    if "text_chars" in wanted:
        out["text_chars"] = tree.size(0)
    if "provenance" in wanted:
        node, found = page.main() if main_only else (0, page.candidates())
        text = tree.string(node)
        name = " ".join(page.identity(node).split())
        out["provenance"] = {
            "strategy": "main_content" if node else "full_document", "hint": f"{tree.tag[node]}:{name}" if name else tree.tag[node],
            "tag": tree.tag[node], "id": tree.get(node, "id"), "classes": tree.get(node, "class"), "candidates": len(found),
            "score": page.score(node) if node else 0, "chars": len(text), "sha256": hashlib.sha256(text.encode()).hexdigest(),
        }
    if "chunks" in wanted:
        out["chunks"] = chunks(md, url or "", chunk_tokens)
    if "outline" in wanted:
        out["outline"] = outline(md)
    return {k: out[k] for k in wanted}


def parse_pages(pages: DataFrame, formats: list[str], key: str = "page_id", main_only: bool = True, chunk_tokens: int = 400) -> DataFrame:
    """``key`` and a column for each format; unknown formats raise ValueError.

    Only what is asked for is computed, and only key, url and html are read.
    Null html is an empty page; its title_source is null.
    """
    unknown = [f for f in formats if f not in FORMATS]
    if unknown:
        raise ValueError(f"unknown formats {unknown}; known are {sorted(FORMATS)}")
    rows = pages.select(key, "url", "html")
    kind = dict(rows.dtypes)[key]
    schema = ", ".join([f"`{key}` {kind}", *(f"{f} {FORMATS[f]}" for f in formats)])
    return rows.mapInArrow(_parser(key, formats, main_only, chunk_tokens), schema)


def _parser(key: str, formats: list[str], main_only: bool, chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = [
                    parse(h, u, formats, main_only, chunk_tokens)
                    for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                ]
                columns = [pa.array([list(m[f].items()) if f == "metadata" else m[f] for m in made], _ARROW[f]) for f in formats]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *formats])

    return run


_S, _I, _L = pa.string(), pa.int32(), pa.int64()
_ARROW = {
    "markdown": _S, "text_chars": _L, "links": pa.list_(_S), "metadata": pa.map_(_S, _S), "title_source": _S,
    "provenance": pa.struct([("strategy", _S), ("hint", _S), ("tag", _S), ("id", _S), ("classes", _S), ("candidates", _I), ("score", _L), ("chars", _L), ("sha256", _S)]),
    "chunks": pa.list_(pa.struct([("id", _I), ("text", _S), ("heading", _S), ("url", _S), ("cite_url", _S), ("estimated_tokens", _I)])),
    "outline": pa.list_(pa.struct([("id", _S), ("heading", _S), ("level", _I), ("tokens", _I)])),
}
