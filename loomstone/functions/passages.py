"""Markdown as passages: blocks, citable chunks, sections, and what fits a budget.

A text is scanned once into blocks, each with its place in the outline.  Chunks,
sections and budgets are groupings of that list.
"""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise

#: Characters that count as one token.
PER_TOKEN = 4
#: How many words a citation quotes.
QUOTED = 8
_HEADING = re.compile(r"(#{1,6})[ \t\f\v\r]+([^\n]*?)\s*#*\s*")
_FENCE = re.compile(r"\s*```")
_IMAGE_OR_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_MARKUP = re.compile(r"[`*_>#|\[\]()!]+|^\s*[-+]\s+|^\s*\d+[.)]\s+")


@dataclass(frozen=True)
class Block:
    """A run of lines; ``path`` holds (level, title) of the headings above it, its own last; ``part`` counts headings so far."""

    text: str
    path: tuple[tuple[int, str], ...] = ()
    part: int = 0
    heads: bool = False

    @property
    def trail(self) -> str:
        return " > ".join(title for _, title in self.path)


def tokens(text: str) -> int:
    return max(1, len(text) // PER_TOKEN) if text else 0


def blocks(md: str) -> Iterator[str]:
    """Runs of lines between blank lines; a fence is never cut."""
    lines = md.split("\n")
    opened = 0
    inside = []  # for each line, whether it belongs to a block
    for line in lines:
        opened += _FENCE.match(line) is not None
        inside.append(bool(line.strip()) or opened % 2 == 1)
    for belongs, run in groupby(range(len(lines)), key=inside.__getitem__):
        if belongs:
            yield "\n".join(lines[k] for k in run)


def scan(md: str) -> list[Block]:
    """The blocks in order with their places in the outline."""
    out: list[Block] = []
    titles: dict[int, str] = {}  # level -> the title now open there
    part = 0
    for text in blocks(md):
        m = _HEADING.fullmatch(text.strip())
        if m:
            level = len(m[1])
            titles = {k: v for k, v in titles.items() if k < level} | {level: m[2]}
            part += 1
        out.append(Block(text, tuple(sorted(titles.items())), part, m is not None))
    return out


def _fill(lengths: list[int], between: int, budget: int, starts: frozenset[int] = frozenset()) -> list[list[int]]:
    """Indices of parts, grouped in order: a group ends before a part of ``starts`` and where one more would exceed the budget.

    between: how many characters join two parts.
    """
    groups: list[list[int]] = []
    held = 0
    for k, length in enumerate(lengths):
        joined = held + between + length
        if not groups or k in starts or joined // PER_TOKEN > budget:
            groups.append([])
            joined = length
        groups[-1].append(k)
        held = joined
    return groups


def _line_pieces(line: str, most: int) -> Iterator[str]:
    """A line in pieces of at most ``most`` characters, cut at the last blank that allows it; blanks at a cut fall away."""
    at = 0
    while len(line) - at > most:
        blank = line.rfind(" ", at + 1, at + most + 1)
        stop = blank if blank > 0 else at + most
        yield line[at:stop]
        at = next((k for k in range(stop, len(line)) if line[k] != " "), len(line))
    yield line[at:]


def pieces(text: str, budget: int) -> list[str]:
    """A block in pieces of at most ``budget`` tokens: whole lines where they fit."""
    if tokens(text) <= budget:
        return [text]
    lines = [piece for line in text.split("\n") for piece in _line_pieces(line, PER_TOKEN * max(1, budget))]
    return ["\n".join(lines[k] for k in group) for group in _fill(list(map(len, lines)), 1, budget)]


def chunks(md: str, url: str, budget: int = 400) -> list[dict]:
    """Citable pieces of at most ``budget`` tokens: text, heading, url, cite_url, estimated_tokens, id."""
    parts = [(b, piece) for b in scan(md) for piece in pieces(b.text, budget)]
    headings = frozenset(k for k, (b, _) in enumerate(parts) if b.heads)
    out = []
    for number, group in enumerate(_fill([len(piece) for _, piece in parts], 2, budget, headings)):
        text = "\n\n".join(parts[k][1] for k in group)
        trail = parts[group[0]][0].trail
        out.append({"id": number, "text": text, "heading": trail, "url": url, "cite_url": cite(url, text), "estimated_tokens": tokens(text)})
    return out


def cite(url: str, text: str) -> str:
    """The URL with a text fragment: the first words of the first line, fences apart, that has two words."""
    if not re.match("https?://", url):
        return url
    shown = (_MARKUP.sub(" ", _IMAGE_OR_LINK.sub(r"\1", line)).split() for line in text.split("\n") if not _FENCE.match(line))
    words = next((w for w in shown if len(w) >= 2), None)
    if words is None:
        return url
    quoted = urllib.parse.quote(" ".join(words[:QUOTED]), safe="").replace("-", "%2D")
    return f"{url.partition('#')[0]}#:~:text={quoted}"


def sections(md: str) -> list[dict]:
    """id, path, level, markdown and stop: the index after the last subsection.

    What stands before the first heading is a section of level 0.
    """
    grouped = [list(g) for _, g in groupby(scan(md), key=lambda b: b.part)]
    levels = [g[0].path[-1][0] if g[0].path else 0 for g in grouped]
    stops = [0] * len(grouped)
    waiting: list[int] = []  # sections whose end is still to come, levels rising
    for k, level in enumerate([*levels, -1]):
        while waiting and (level <= levels[waiting[-1]] or levels[waiting[-1]] == 0):
            stops[waiting.pop()] = k
        waiting.append(k)
    return [
        {
            "id": f"s{k + 1}", "path": [title for _, title in g[0].path], "level": levels[k],
            "markdown": "\n\n".join(b.text for b in g), "stop": stops[k],
        }
        for k, g in enumerate(grouped)
    ]


def outline(md: str) -> list[dict]:
    """id, heading, level and the tokens of each section with its subsections."""
    found = sections(md)
    sums = [0]
    for s in found:
        sums.append(sums[-1] + tokens(s["markdown"]))
    title = lambda s: " > ".join(s["path"]) or "(before the first heading)"
    return [
        {"id": s["id"], "heading": title(s), "level": s["level"], "tokens": sums[s["stop"]] - sums[k]} for k, s in enumerate(found)
    ]


def section(md: str, wanted: str) -> str | None:
    """A section with its subsections by id, else by its own heading, else by a part of its path; the first of several."""
    found, key = sections(md), wanted.strip().casefold()
    ways = [
        lambda s: s["id"] == key,
        lambda s: bool(s["path"]) and s["path"][-1].casefold() == key,
        lambda s: key in " > ".join(s["path"]).casefold(),
    ]
    for way in ways:
        for k, s in enumerate(found):
            if way(s):
                return "\n\n".join(x["markdown"] for x in found[k : s["stop"]])
    return None


def within_budget(md: str, scores: list[float], limit: int) -> str | None:
    """The blocks with the best scores that fit in ``limit`` characters, each with its nearest heading; None if none do."""
    parts = list(blocks(md))
    titles = [k for k, b in enumerate(parts) if b.lstrip().startswith("#")]
    nearest: dict[int, int] = {}
    for title, after in pairwise([*titles, len(parts)]):
        nearest |= dict.fromkeys(range(title, after), title)
    room, taken = limit, set()
    for _, k in sorted((-score, k) for k, score in enumerate(scores) if score > 0):
        needed = {k, nearest.get(k, k)} - taken
        price = sum(2 + len(parts[j]) for j in needed)
        if price <= room:
            room -= price
            taken |= needed
    return "\n\n".join(parts[k] for k in sorted(taken)) or None
