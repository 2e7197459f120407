"""Which part of a page is content.

Every element gets a row of numbers (text, links, blocks, ...) and a set of marks
(bits) that say why it might be left out.  What a mode of reading leaves out is a
bit mask; what is gone below a root is a running sum over the marked intervals;
the best root is a weighted sum over the columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property

import numpy as np

from loomstone.functions.html_tree import UNREAD, Tree
from loomstone.functions.pages import COOKIE

# Words that name what is not content, and what is.  Those of the second group count on nodes of links only.
SURE_WORDS = "cookie consent newsletter popup advert ads breadcrumb pagination toc social-share share-buttons related-posts".split()
SOFT_WORDS = "banner modal promo sidebar sticky rail".split()
CONTENT_WORDS = "article body content entry main post story documentation docs readme doc-content page-content".split()
INDEX_TITLE = r"(?:[A-Z]\.\s*|Appendix [A-Z]\.?\s*)?Index"
OFF_SCREEN = {"hidden", "sr-only", "visually-hidden", "screen-reader-only"}
CHROME = {"nav", "header", "footer", "aside", "form"}
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
NOTICE_TAGS = {"p", "div", "section", "aside", "small", "span", "li"}
HEADINGS = {"h1", "h2", "h3"}


def _any_word(words: list[str]) -> re.Pattern:
    return re.compile(rf"\b(?:{'|'.join(map(re.escape, words))})\b", re.I)


_SURE, _SOFT, _CONTENT = map(_any_word, (SURE_WORDS, SOFT_WORDS, CONTENT_WORDS))
_NOTICE = re.compile(COOKIE, re.I)
#: A word that every cookie phrase has, for skipping pages without.
_NOTICE_WORD = re.compile("cookie|continuing", re.I)
_INDEX = re.compile(INDEX_TITLE, re.I)
_NOTHING_HIGH = re.compile(r"0+(?:\.0+)?(?:px|pt|em|rem|%)?$")

#: Marks.  PAGE_HEADER stands beside CHROME on headers that belong to an article around them, if there is one.
SILENT, NAMED, HIDDEN, HIDDEN_BY_CLASS, LISTING, CHROME_PART, PAGE_HEADER, NOTICE = (1 << k for k in range(8))
ALWAYS = SILENT | NAMED | HIDDEN | NOTICE
WHOLE_PAGE = ALWAYS | HIDDEN_BY_CLASS
MAIN_ONLY = WHOLE_PAGE | LISTING | CHROME_PART

#: Signs of a concealed element, and what they come to; the first row of which all signs are there decides.
CONCEALED: list[tuple[set[str], int]] = [
    ({"tab panel"}, 0),  # behind a tab, but content
    ({"hidden attribute"}, HIDDEN),
    ({"off-screen class", "table part"}, 0),
    ({"aria-hidden", "mostly links"}, HIDDEN),
    ({"aria-hidden"}, 0),
    ({"off-screen class", "style"}, HIDDEN | HIDDEN_BY_CLASS),
    ({"off-screen class"}, HIDDEN_BY_CLASS),
    ({"style"}, HIDDEN),
]

#: What the score of a root is made of.
WEIGHTS = {
    "text": 1, "blocks": 80, "has title": 500, "is root": 350, "named content": 250,
    "links": -15, "named": -700, "listing": -10_000, "named below": -120,
}


def declarations(style: str) -> dict[str, str]:
    """The properties of a style attribute in lower case, without ``!important``."""
    pairs = (part.partition(":") for part in style.lower().split(";"))
    cleaned = ((name.strip(), re.sub(r"\s*!\s*important\s*$", "", value).strip()) for name, _, value in pairs)
    return {name: value for name, value in cleaned if value}


class Page:
    """The columns and marks of a tree's nodes, and the events of its content."""

    def __init__(self, tree: Tree):
        self.t = tree
        self.end = np.asarray(tree.end)
        self.start = np.arange(len(tree.end))
        self.text, self.link_text = tree.sizes()
        self.element = np.fromiter((tag is not None for tag in tree.tag), bool, len(tree.tag))
        #: Elements with attributes, which alone have names.
        self.marked = [i for i, a in enumerate(tree.attrs) if a]

    def identity(self, i: int) -> str:
        return " ".join(self.t.get(i, n) for n in ("id", "class", "role"))

    def landmark(self, i: int) -> bool:
        return self.t.tag[i] == "main" or self.t.get(i, "role").lower() == "main"

    def tagged(self, tags: set[str]) -> np.ndarray:
        return self.flags(i for tag in tags for i in self.t.tagged.get(tag, ()))

    def flags(self, nodes: Iterable[int]) -> np.ndarray:
        out = np.zeros(len(self.end), bool)
        out[list(nodes)] = True
        return out

    def below(self, flags: np.ndarray) -> np.ndarray:
        """For each node, how many of its descendants have a flag."""
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[self.end] - sums[self.start + 1]

    def around(self, flags: np.ndarray, root: int) -> np.ndarray:
        """For each node, how many nodes of the subtree of ``root`` with a flag hold it, itself included."""
        which = np.flatnonzero(flags)
        which = which[(which >= root) & (which < self.end[root])]
        change = np.zeros(len(flags) + 1, np.int64)
        np.add.at(change, which, 1)
        np.add.at(change, self.end[which], -1)
        return np.cumsum(change)[:-1]

    # -- marks ------------------------------------------------------------------
    @cached_property
    def mostly_links(self) -> np.ndarray:
        return (self.text < 40) | (2 * self.link_text >= self.text)

    @cached_property
    def landmarks(self) -> np.ndarray:
        return self.flags([*self.t.tagged.get("main", ()), *(i for i in self.marked if self.landmark(i))])

    @cached_property
    def marks(self) -> np.ndarray:
        t = self.t
        out = np.where(self.tagged(UNREAD), SILENT, 0)
        sized = {i: s for i in self.marked if "style" in t.attrs[i] and (s := declarations(t.get(i, "style")))}
        resized = self.below(self.flags(i for i, s in sized.items() if "font-size" in s))
        for i in self.marked:
            out[i] |= self._named(i) | self._concealed(i, sized.get(i, {}), resized[i] > 0)
        out[self._listings()] |= LISTING
        forms, headers = self.tagged({"form"}), self.tagged({"header"})
        wraps_page = forms & (self.below(self.tagged({"h1", "h2", "main", "article"})) > 0)
        out[self.tagged(CHROME) & ~wraps_page] |= CHROME_PART
        out[headers & (2 * self.link_text < self.text)] |= PAGE_HEADER
        if any(_NOTICE_WORD.search(x) for x in t.text):
            for i in np.flatnonzero(self.tagged(NOTICE_TAGS) & (self.text > 0) & (self.text <= 600)):
                if _NOTICE.search(t.head(i, 160)[:160]):
                    out[i] |= NOTICE
        return out

    def _named(self, i: int) -> int:
        if self.t.tag[i] in ("html", "body") or self.landmarks[i]:
            return 0
        # Names with brackets and the like are utility classes.
        names = " ".join(w for w in self.identity(i).split() if not re.search(r"[\[\]:\"']", w))
        return NAMED if _SURE.search(names) or (self.mostly_links[i] and _SOFT.search(names)) else 0

    def _concealed(self, i: int, style: dict[str, str], resized: bool) -> int:
        t = self.t
        unseen = style.get("display") == "none" or style.get("visibility") == "hidden"
        flat = bool(_NOTHING_HIGH.match(style.get("font-size", "x"))) and not resized
        signs = {
            "tab panel": t.get(i, "role").lower() == "tabpanel",
            "hidden attribute": "hidden" in t.attrs[i] and t.get(i, "hidden").lower() != "until-found",
            "off-screen class": not OFF_SCREEN.isdisjoint(self.identity(i).lower().replace("_", "-").split()),
            "table part": t.tag[i] in ("thead", "caption"),
            "aria-hidden": t.get(i, "aria-hidden").lower() == "true",
            "mostly links": self.mostly_links[i],
            "style": unseen or flat,
        }
        here = {name for name, there in signs.items() if there}
        return next((verdict for needed, verdict in CONCEALED if needed <= here), 0)

    def _listings(self) -> list[int]:
        """Tables of contents by name, and sections whose first heading, at most two levels down, says Index."""
        t = self.t
        first: dict[int, int] = {}
        for h in np.flatnonzero(self.tagged(HEADINGS)):
            p = t.parent[h]
            holders = [p] if t.tag[p] in ("section", "article") else [p, t.parent[p]]
            for holder in holders:
                if holder >= 0 and t.tag[holder] in ("section", "div"):
                    first.setdefault(holder, h)
        titled = [holder for holder, h in first.items() if _INDEX.fullmatch(t.string(h))]
        named = [i for i in self.marked if not {"toc", "genindex"}.isdisjoint(self.identity(i).lower().split())]
        return [*titled, *named]

    # -- the best root --------------------------------------------------------------
    @cached_property
    def columns(self) -> dict[str, np.ndarray]:
        blocks, links, titles = (self.tagged(x) for x in ({"p", "pre", "table", "li"}, {"a"}, {"h1"}))
        named = self.marks & NAMED > 0
        return {
            "text": self.text, "blocks": self.below(blocks), "has title": self.below(titles) > 0,
            "is root": self.tagged({"main", "article", "body"}), "links": self.below(links), "named": named,
            "named content": self.flags(i for i in self.marked if _CONTENT.search(self.identity(i))),
            "listing": self.marks & LISTING > 0, "named below": self.below(named),
        }

    @cached_property
    def scores(self) -> np.ndarray:
        return sum(weight * self.columns[name].astype(np.int64) for name, weight in WEIGHTS.items())

    def score(self, i: int) -> int:
        return int(self.scores[i])

    def candidates(self) -> list[int]:
        c = self.columns
        shown = self.marks & (NAMED | HIDDEN | HIDDEN_BY_CLASS) == 0
        fit = self.tagged(CONTAINERS) & (self.text >= 120) & (c["blocks"] >= 2) & shown
        return np.flatnonzero(fit & (self.landmarks | (c["links"] <= 2 * c["blocks"]))).tolist()

    def main(self) -> tuple[int, list[int]]:
        """The content node (the document where there is no candidate) and the candidates.

        The best score wins, the first of equals; a landmark inside it that holds half of its text is taken instead.
        """
        found = self.candidates()
        if not found:
            return 0, found
        best = max(found, key=self.score)
        inner = [i for i in found if best < i < self.end[best] and self.landmarks[i]]
        mark = max(inner, key=self.score, default=best)
        takes = not self.landmarks[best] and 2 * self.text[mark] >= self.text[best]
        return (mark if takes else best), found

    # -- what is left ---------------------------------------------------------------
    def kept(self, root: int, left_out: int) -> list[tuple[int, bool]]:
        """(node, entering) events of what is left below ``root``, in order; text nodes only enter."""
        marks = self.marks & left_out
        holders = self.landmarks | self.tagged({"article"})
        inside = self.around(holders, root) - holders > 0
        marks = np.where((self.marks & PAGE_HEADER > 0) & inside, marks & ~CHROME_PART, marks)
        marks[0] = 0
        gone = self.around(marks > 0, root) > 0
        left = [i for i in range(root, self.t.end[root]) if not gone[i]]
        # At one place, what ends there comes before what begins, the inner before the outer.
        places = [(i, 1, i) for i in left] + [(self.t.end[i], 0, -i) for i in left if self.element[i]]
        return [(abs(i), enters == 1) for _, enters, i in sorted(places)]

    def content(self, main_only: bool = True) -> list[tuple[int, bool]]:
        """Events of the content; never next to nothing for a page that has text."""
        if not main_only:
            return self.kept(0, WHOLE_PAGE)
        letters = lambda events: sum(len("".join(self.t.text[i].split())) for i, _ in events if not self.element[i])
        best = self.kept(self.main()[0], MAIN_ONLY)
        enough = 0.25 * self.t.size(0) if self.t.size(0) >= 500 else 0
        for wider in (MAIN_ONLY, MAIN_ONLY & ~HIDDEN_BY_CLASS):
            if letters(best) < enough:
                best = max(best, self.kept(0, wider), key=letters)
        return best
