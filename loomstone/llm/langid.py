"""Language identification by a small byte-level convolutional network in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows,
the greatest answer of each filter goes to a softmax.  All windows of a text are
scored, and a text's probabilities are the mean over its windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.columns import pick
from loomstone.llm.textarrays import column_bytes, slices

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 24, 8
#: The model is fitted on at most this many texts of each language, chosen by a hash of the id, ...
FIT_TEXTS = 600
#: ... and on this many windows of each text, spread evenly over it.
FIT_WINDOWS = 3
#: It knows the most frequent languages, so many at most.
FIT_LANGUAGES = 256
EPOCHS = 6


@dataclass
class Network:
    """Weights; ``languages`` name the outputs."""

    languages: list[str]
    embedding: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # (width * EMBED) x FILTERS each
    biases: list[np.ndarray]
    out: np.ndarray  # (FILTERS * widths) x languages
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return cls(
            languages, (r.standard_normal((256, EMBED)) * 0.5).astype(np.float32),
            [f(w * EMBED, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            f(FILTERS * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray, keep: bool = False):
        """The greatest answer of each filter over each row of bytes, at least 0; with what backward() needs."""
        x = self.embedding[windows]
        n, size, e = x.shape
        tops, kept = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            view = np.lib.stride_tricks.as_strided(x, (n, size - w + 1, w * e), x.strides)
            made = view.reshape(-1, w * e) @ f
            made = made.reshape(n, size - w + 1, -1)
            top = made.max(axis=1) + b
            tops.append(np.maximum(top, 0))
            if keep:
                kept.append((view, made.argmax(axis=1), top > 0))
        return np.concatenate(tops, axis=1), kept

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows)[0] @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order of weights()."""
        hidden, kept = self.pooled(windows, keep=True)
        z = hidden @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p /= len(labels)
        back = p @ self.out.T
        embedding, filters, biases = np.zeros_like(self.embedding), [], []
        rows = np.arange(len(labels))[:, None]
        for k, (w, f, (view, where, on)) in enumerate(zip(WIDTHS, self.filters, kept, strict=True)):
            d = back[:, k * FILTERS : (k + 1) * FILTERS] * on
            biases.append(d.sum(axis=0))
            seen = view[rows, where]  # rows x filters x (w * e)
            filters.append(np.einsum("nf,nfe->ef", d, seen))
            dx = (d[:, :, None] * f.T[None]).reshape(len(labels), FILTERS, w, EMBED)
            for i in range(w):
                np.add.at(embedding, windows[rows, where + i], dx[:, :, i])
        return [embedding, *filters, *biases, hidden.T @ p, p.sum(axis=0)]


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, batch: int = 64) -> Network:
    """Train by Adam; languages weigh the same whatever their counts."""
    net = Network.fresh(languages)
    weights = net.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    r = np.random.default_rng(5)
    share = 1 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)[labels]
    share /= share.sum()
    step, steps = 0, max(1, epochs * len(labels) // batch)
    for _ in range(steps):
        take = r.choice(len(labels), batch, p=share)
        step += 1
        rate = 0.01 * (1 - 0.9 * step / steps)
        for w, g, m, v in zip(weights, net.gradients(windows[take], labels[take]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def cut(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of all rows (n x size bytes, zeros behind the end) and the row of each, ``at_once`` windows at a time.

    Windows of a row overlap by the widest filter less one, so no n-gram is lost.
    Only the windows at hand are copied, so a text of any length takes little more than itself.
    """
    stride = size - max(WIDTHS) + 1
    length = np.diff(offsets)
    count = np.where(length > 0, 1 + np.maximum(0, -(-(length - size) // stride)), 0)
    ends = np.cumsum(count)
    for low in range(0, int(ends[-1]) if len(ends) else 0, at_once):
        window = np.arange(low, min(low + at_once, int(ends[-1])))
        row = np.searchsorted(ends, window, side="right")
        first = offsets[row] + (window - (ends - count)[row]) * stride
        at = first[:, None] + np.arange(size)
        inside = at < offsets[row + 1][:, None]
        yield np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), row


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_windows(docs: DataFrame, per_language: int = FIT_TEXTS) -> list[tuple[str, list[str]]]:
    """(language, windows) of a bounded sample of the texts that may be learnt from.

    Texts are counted by language first.  From the counts follows a bound on the
    hash of the id below which about twice the wanted number lie, so tasks send
    so many rows and no more, whatever the size of the corpus; repeated rows count once.
    """
    rows = pick(docs, "doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null")
    rows = rows.filter(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FIT_LANGUAGES).collect()
    if not counts:
        return []
    hashed = F.xxhash64("doc_id", "text")
    bounds = [(r["lang"], min(1.0, 2 * (per_language + 50) / r["count"])) for r in counts]
    share = F.create_map(*(F.lit(x) for pair in bounds for x in pair))
    unit = F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
    gap = F.greatest(F.lit(0), F.length("text") - WINDOW) / max(1, FIT_WINDOWS - 1)
    parts = F.array(*(F.substring("text", 1 + F.floor(gap * i).cast("int"), F.lit(WINDOW)) for i in range(FIT_WINDOWS)))
    near = rows.filter(unit < F.try_element_at(share, F.col("lang")))
    got = near.select("lang", "doc_id", hashed.alias("h"), F.array_distinct(parts).alias("parts")).distinct().collect()
    order = sorted(got, key=lambda r: (r["h"], r["doc_id"], r["parts"]))
    taken: Counter[str] = Counter()
    out = []
    for r in order:
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= per_language:
            out.append((r["lang"], r["parts"]))
    return out


def train(docs: DataFrame, per_language: int = FIT_TEXTS) -> Network | None:
    """A network for the languages of ``docs``; None where nothing is labelled."""
    sample = training_windows(docs, per_language)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    text, label = [], []
    for lang, parts in sample:
        for p in parts:
            raw = p.encode()[:WINDOW]
            text.append(np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8))
            label.append(languages.index(lang))
    return fit(np.stack(text), np.array(label), languages)


def _predict(shared, batch_windows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = shared.value
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                n = batch.num_rows
                names = np.full(n, "und", dtype=object)
                score = np.zeros(n)
                if net is not None:
                    total = np.zeros((n, len(net.languages)))
                    for windows, row in cut(*column_bytes(batch.column(1)), at_once=batch_windows):
                        np.add.at(total, row, net.probabilities(windows))
                    letters = np.array(batch.column(2).to_pylist(), dtype=bool) & (total.sum(axis=1) > 0)
                    best = total.argmax(axis=1)
                    names[letters] = np.array(net.languages, dtype=object)[best[letters]]
                    score[letters] = total[letters, best[letters]] / total[letters].sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))],
                    names=["doc_id", "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score.

    Without a network, one is trained on labelled texts (column lang) whose crc32
    remainder is not 1.  ``lang_pred`` is und with score 0 where the text is null
    or has no letter, or where there was nothing to learn from; ``score`` is the
    probability of the prediction.  A null doc_id gives a null held_out; repeated
    rows are predicted each; an empty table gives no rows.
    """
    if network is None:
        network = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(network)  # some tens of kilobytes
    rows = pick(docs, "doc_id", "text").select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predict(shared), "doc_id bigint, lang_pred string, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
