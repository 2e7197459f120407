"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A passage of m characters that is found again with at most k edits shares at
least m + 1 - q (k + 1) q-grams with its place, all on diagonals (text position
less passage position) that lie within k of each other.  So hits of shared
q-grams are counted in diagonal bands of twice the width k + 1 that overlap by
half, for whole items first and then for the passages of what is left; bands
that reach the bound are kept, and only they are aligned.

Passages are short windows of the benchmark items at a small stride, so that any
excerpt of WINDOW characters is found, wherever it starts.  Letter case and runs of white space do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.columns import pick

Q = 8
#: Windows of long items, how far apart they start, and the share of a window that edits may touch.
#: An excerpt of WINDOW characters lies within half a stride of a window, which costs no more edits than it may have.
WINDOW, STRIDE, RATE = 50, 5, 0.08
#: Items below this length, which have no q-gram, are too short to tell and match nothing.
SHORTEST = Q
#: Texts are searched in pieces of at most this many characters that overlap by what a passage and its edits may take, ...
PIECE, OVERLAP = 1 << 18, 2 * WINDOW
#: ... and a piece with more than HITS hits is halved until it is this short.
LEAST_PIECE = 8 * WINDOW
#: Hits and alignments that are held at once.
HITS, ALIGNED = 1 << 20, 2048
#: Benchmark characters in one index; a larger benchmark is searched in several passes.
INDEX_CHARS = 4_000_000
_BITS = 21
_U = np.uint64


def normalize(text: str | None) -> str:
    """Lower case, white space and NUL to single blanks."""
    return " ".join((text or "").replace("\x00", " ").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _folded(points: np.ndarray) -> np.ndarray:
    """One byte for each character: equal characters stay equal, and few others collide."""
    return ((points ^ (points >> 8) * 151 ^ (points >> 16) * 31) & 0xFF).astype(np.uint8)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of the Q characters (12 at most) from each place on."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    data = np.concatenate([_folded(points), np.zeros(8, np.uint8)])
    n = len(points) - Q + 1
    eight = np.ndarray((n,), "<u8", data, 0, (1,))
    four = np.ndarray((n,), "<u4", data, 8, (1,))
    # Only the first Q bytes of the twelve count.
    out = (eight & _U((1 << 8 * min(Q, 8)) - 1)) * _U(0x9E3779B97F4A7C15)
    if Q > 8:
        out ^= out >> _U(32)
        out += (four & np.uint32((1 << 8 * (Q - 8)) - 1)).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    out ^= out >> _U(32)
    out *= _U(0xD6E8FEB86659FD93)
    return out ^ (out >> _U(29))


def window_starts(text: str) -> list[int]:
    """Where the passages of an item start; the last one ends with the item."""
    if len(text) < SHORTEST:
        return []
    return [*range(0, len(text) - WINDOW, STRIDE), max(0, len(text) - WINDOW)]


def windows(text: str) -> list[str]:
    """The passages of an item: itself if short, else overlapping windows; none below SHORTEST characters."""
    return [text[s : s + WINDOW] for s in window_starts(text)]


def pieces(text: str, size: int) -> list[str]:
    """A text in pieces of ``size`` characters at most, each but the first beginning OVERLAP before the last one's end."""
    if len(text) <= size:
        return [text]
    return [text[s : s + size] for s in range(0, len(text) - OVERLAP, size - OVERLAP)]


def budget(m: int) -> int:
    """How many edits a passage of m characters may have, so that the lemma still asks for a shared gram."""
    return max(0, min(int(RATE * m), m // Q - 1))


class Index:
    """The q-grams of a bounded set of items, each gram once for each place in its item."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.item, points, starts = [], [], []
        for item_id, text in items:
            text = normalize(text)
            if begins := window_starts(text):
                self.item.append(item_id)
                points.append(code_points(text))
                starts.append(np.array(begins, dtype=np.int32))
        #: All items' characters, and where each item begins; of each passage its start in the item; of each item
        #: its first passage, how many there are, and their length.
        self.points = np.concatenate(points) if points else np.zeros(0, np.uint32)
        size = np.array([len(p) for p in points], dtype=np.int64)
        self.origin = np.cumsum(size) - size
        self.begins = np.concatenate(starts) if starts else np.zeros(0, np.int32)
        self.count = np.array([len(x) for x in starts], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.length = np.minimum(size, WINDOW)
        self.edits = np.array([budget(m) for m in self.length.tolist()], dtype=np.int64)
        self.need = self.length + 1 - Q * (self.edits + 1)
        hashes = [gram_hashes(p) for p in points]
        sizes = [len(h) for h in hashes]
        grams = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")
        self.grams = np.unique(grams)
        self.bounds = np.append(np.searchsorted(grams[order], self.grams), len(grams))
        self.owner, self.place = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[(self.grams >> _U(64 - _BITS)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(index of the text, index of the item, edits) of every match, the fewest edits of each among them; texts are normalized.

        A match lies in OVERLAP characters, so it lies whole in some piece, and
        neither long texts nor frequent grams make more hits at once than a piece has.
        """
        if self.item and texts:
            cut = [(i, p) for i, t in enumerate(texts) for p in pieces(t, PIECE)]
            yield from self._pieces([p for _, p in cut], [i for i, _ in cut])

    def _pieces(self, texts: list[str], owners: list[int]) -> Iterator[tuple[int, int, int]]:
        points = code_points("\x00".join(texts))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        hashes = gram_hashes(points)
        at = np.flatnonzero(self.bitmap[(hashes >> _U(64 - _BITS)).astype(np.int64)])
        found = hashes[at]
        gram = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        real = self.grams[gram] == found
        at, gram = at[real], gram[real]
        # Slices bound the hits that are held at once; a slice has whole texts.
        counts = self.bounds[gram + 1] - self.bounds[gram]
        row = np.searchsorted(starts, at, side="right") - 1
        total = np.cumsum(counts)
        low = 0
        while low < len(at):
            high = int(np.searchsorted(total, (total[low - 1] if low else 0) + HITS, side="right"))
            high = int(np.searchsorted(row, row[min(max(high, low), len(row) - 1)], side="left")) if high < len(at) else high
            if high <= low:
                high = int(np.searchsorted(row, row[low], side="right"))
            r = int(row[low])
            if high - low and total[high - 1] - (total[low - 1] if low else 0) > HITS and len(texts[r]) > LEAST_PIECE:
                halves = pieces(texts[r], (len(texts[r]) + OVERLAP) // 2 + 1)
                yield from self._pieces(halves, [owners[r]] * len(halves))
            else:
                for t, i, edits in self._matches(points, starts, at[low:high], gram[low:high], row[low:high]):
                    yield owners[t], i, edits
            low = high

    def _matches(self, points, starts, at, gram, row) -> Iterator[tuple[int, int, int]]:
        counts = self.bounds[gram + 1] - self.bounds[gram]
        entry = np.repeat(self.bounds[gram] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        at, row = np.repeat(at, counts), np.repeat(row, counts)
        owner, place = self.owner[entry].astype(np.int64), self.place[entry].astype(np.int64)
        band = (at - starts[row] - place) // (self.edits[owner] + 1)
        if not len(band):
            return
        # Whole items first: few of them have enough hits on near diagonals for any of their passages.
        offset = int(-band.min()) + 1
        span = int(band.max()) + offset + 2
        key = (row * len(self.item) + owner) * span + band + offset
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        hits, ordered = np.diff(np.append(edge, len(key))), ordered[edge]
        need = self.need[ordered // span % len(self.item)]
        joint = ordered[1:] == ordered[:-1] + 1
        pair = hits + np.append(np.where(joint, hits[1:], 0), 0)
        enough = pair >= need
        enough[1:] |= joint & enough[:-1]
        left = order[np.repeat(enough, hits)]
        row, owner, place, band = row[left], owner[left], place[left], band[left]
        # Then their passages: a gram counts for those that hold it whole.
        begins = np.repeat(self.first[owner], n := self.count[owner]) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which = np.repeat(np.arange(len(owner)), n)
        gap = place[which] - self.begins[begins]
        inside = (gap >= 0) & (gap <= self.length[owner[which]] - Q)
        passage, which = begins[inside], which[inside]
        if not len(which):
            return
        key = (row[which] * len(self.begins) + passage) * span + band[which] + offset
        keys, first, hits = np.unique(np.concatenate([key, key - 1]), return_index=True, return_counts=True)
        which = np.concatenate([which, which])[first]
        enough = hits >= self.need[owner[which]]
        pair, low, items = keys[enough] // span, keys[enough] % span - offset, owner[which[enough]]
        rows, begins = pair // len(self.begins), self.begins[pair % len(self.begins)]
        best: dict[tuple[int, int], int] = {}
        for k, m in sorted(set(zip(self.edits[items].tolist(), self.length[items].tolist(), strict=True))):
            mine = np.flatnonzero((self.edits[items] == k) & (self.length[items] == m))
            for c in range(0, len(mine), ALIGNED):
                part = mine[c : c + ALIGNED]
                r, i, b = rows[part], items[part], begins[part]
                places = (starts[r] + b + low[part] * (k + 1) - k)[:, None] + np.arange(m + 4 * k + 1)
                real = (places >= starts[r][:, None]) & (places < starts[r + 1][:, None] - 1)
                regions = np.where(real, points[np.clip(places, 0, len(points) - 1)], 0)
                edits = distances(self.points[(self.origin[i] + b)[:, None] + np.arange(m)], regions)
                for x in np.flatnonzero(edits <= k).tolist():
                    at = int(r[x]), int(i[x])
                    best[at] = min(int(edits[x]), best.get(at, k))
        for (r, i), edits in best.items():
            yield r, i, edits


def distances(passages: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Row by row the fewest edits that turn a passage into a part of its region, along the diagonals that start in it.

    The lanes are the diagonals on which the passage's length fits; a region's 0 matches nothing.
    """
    m = passages.shape[1]
    lanes = regions.shape[1] - m + 1
    p, r = np.ascontiguousarray(passages.T), np.ascontiguousarray(regions.T)
    now = np.zeros((lanes, len(passages)), np.uint8)
    for i in range(m):
        step = now + (r[i : i + lanes] != p[i])
        np.minimum(step[:-1], now[1:] + 1, out=step[:-1])
        for j in range(1, lanes):
            np.minimum(step[j], step[j - 1] + 1, out=step[j])
        now = step
    return now.min(axis=0)


def distance(passage: str, region: str, k: int) -> int | None:
    """The fewest edits that turn ``passage`` into some part of ``region``, if at most k.

    Rows are the passage's characters, columns the diagonals of the region: a
    band, since the region is little longer than the passage.
    """
    if passage in region:
        return 0
    if k == 0:
        return None
    p, r = code_points(passage), code_points(region)
    m, wide = len(p), max(1, len(region) - len(passage) + k + 1)
    padded = np.concatenate([np.zeros(k, np.uint32), r, np.zeros(m + wide, np.uint32)])
    far = m + k + 1
    lanes = np.arange(wide + k)
    # Diagonal d stands for region place i + d - k; places before or behind the region never match.
    now = np.where(lanes - k >= 0, np.where(lanes - k <= len(r), 0, far), far)
    for i in range(m):
        same = padded[i : i + wide + k] == p[i]
        inside = (lanes + i >= k) & (lanes + i < k + len(r))
        step = np.where(same & inside, now, np.where(inside, now + 1, far))
        step[:-1] = np.minimum(step[:-1], now[1:] + 1)
        now = np.minimum.accumulate(step - lanes) + lanes
        now = np.where(lanes + i + 1 - k <= len(r), now, far)
        if now.min() > k:
            return None
    best = int(now.min())
    return best if best <= k else None


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in indexes of bounded size, each read when it is needed."""
    items = pick(benchmark, "item_id", "text", types={"item_id": "bigint"})
    total = items.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0))).first()[0]
    n = -(-total // INDEX_CHARS)
    for b in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        yield Index([(r["item_id"], r["text"]) for r in block.collect()])


def _texts(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, normalized texts) in groups of about ``limit`` characters."""
    first, group, held = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        group.append(normalize(t.as_py()))
        held += len(group[-1])
        if held >= limit:
            yield first, group
            first, group, held = i + 1, [], 0
    if group:
        yield first, group


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits): each benchmark item of which a document holds a passage.

    ``edits`` is the fewest over the item's passages.  Null and empty texts hold
    nothing; items below SHORTEST characters are too short to tell and match nothing; a
    null doc_id or item_id is reported as null; repeated rows give one row; an
    empty table gives no rows.  The index of at most INDEX_CHARS characters goes
    to every executor; a larger benchmark makes several passes over the texts.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text")
    schema = "doc_id bigint, item_id bigint, edits int"
    out = spark.createDataFrame([], schema)
    for index in _blocks(benchmark):
        out = out.unionByName(rows.mapInArrow(_leaks(spark.sparkContext.broadcast(index)), schema))
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _leaks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0)
            found = [
                (ids[first + r].as_py(), index.item[w], edits)
                for first, group in _texts(batch, 1)
                for r, w, edits in index.search(group)
            ]
            d, i, e = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(e, pa.int32())], names=["doc_id", "item_id", "edits"]
            )

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns; nothing is shuffled.

    Null and empty texts hold none; rows without doc_id or with a repeated one are judged each; an empty
    benchmark keeps all.
    """
    column = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    for index in _blocks(benchmark):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(index), column), docs.schema)
    return docs


def _clean(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for first, group in _texts(batch, column):
                for r, _, _ in index.search(group):
                    keep[first + r] = False
            yield batch.filter(pa.array(keep))

    return run
