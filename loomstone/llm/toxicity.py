"""Toxicity by a factorization machine over hashed terms.

A text is its set of distinct hashed words.  The score adds a weight for each
term and, for each pair of terms, the product of their factors: two words that
are harmless alone can be toxic together, and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.columns import pick
from loomstone.llm.langid import held_out
from loomstone.llm.textarrays import mix, slices

#: Hashed terms, factors of each.
BITS, RANK = 20, 8
#: The first bytes of a longer word are a term too, for what inflects.
STEM = 7
#: The model is fitted on at most this many labelled texts, chosen by a hash of the id.
FIT_TEXTS = 12_000
#: Of the terms in at least MIN_TEXTS of them, the TOP_TERMS that tell the labels apart best have weights.
MIN_TEXTS, TOP_TERMS = 3, 1024
#: ... and differ by this many standard deviations.
MIN_WORTH = 2.5
EPOCHS = 30
#: What lies around words.
_STRIP = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())


def terms(text: bytes) -> np.ndarray:
    """Sorted distinct hashed words and stems of a text: A-Z lower-cased, marks around a word dropped."""
    words = {w.strip(_STRIP) for w in set(text.lower().split())}
    words.discard(b"")
    words |= {b"^" + w[:STEM] for w in words if len(w) > STEM}
    if not words:
        return np.zeros(0, np.int64)
    return np.unique(np.fromiter(map(_hash, words), dtype=np.int64, count=len(words)))


def _hash(word: bytes) -> int:
    # Bytes hash alike in every process only by a function of our own.
    import zlib

    return (zlib.crc32(word) * 0x9E3779B1 + zlib.adler32(word) * 0x85EBCA77 >> 7) & ((1 << BITS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Machine:
    """bias, weights (terms) and factors (terms x RANK) of the known terms; all others count nothing."""

    known: np.ndarray  # sorted term ids
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """How likely label 1 is for each set of terms, 0 to 1."""
        return _sigmoid(self.margins(rows))

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(r) for r in rows])
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(rows)), size)
        at = np.searchsorted(self.known, flat)
        at[at == len(self.known)] = 0
        hit = self.known[at] == flat if len(self.known) else np.zeros(len(flat), bool)
        return self._margin(row[hit], at[hit], len(rows))[0]

    def _margin(self, row: np.ndarray, at: np.ndarray, n: int):
        linear = np.bincount(row, self.weight[at], n)
        v = self.factor[at]
        total = np.zeros((n, RANK))
        square = np.zeros(n)
        np.add.at(total, row, v)
        np.add.at(square, row, (v * v).sum(axis=1))
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - square), total


def select(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The terms whose counts differ most between the labels, by the chi-square statistic; sorted."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    ids, at = np.unique(flat, return_inverse=True)
    every = np.bincount(at, minlength=len(ids))
    ones = np.bincount(at, np.repeat(labels, [len(r) for r in rows]), len(ids)) if rows else every
    share = labels.mean() if len(labels) else 0.0
    spread = np.sqrt(np.maximum(every * share * (1 - share), 1e-9))
    worth = np.where(every >= MIN_TEXTS, np.abs(ones - every * share) / spread, 0)
    best = np.lexsort((ids, -worth))[:TOP_TERMS]
    return np.sort(ids[best[worth[best] >= MIN_WORTH]])


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 128, decay: float = 1e-2) -> Machine:
    """Logistic loss by Adam, weight decay on weights and factors."""
    r = np.random.default_rng(3)
    known = select(rows, labels)
    kept = []
    for x in rows:
        at = np.searchsorted(known, x)
        at[at == len(known)] = 0
        kept.append(at[known[at] == x] if len(known) else at[:0])
    rate1 = float(np.clip(labels.mean() if len(labels) else 0, 1e-3, 1 - 1e-3))
    model = Machine(known, np.log(rate1 / (1 - rate1)), np.zeros(len(known)), r.standard_normal((len(known), RANK)) * 0.01)
    params = [model.weight, model.factor]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs if len(labels) else 0):
        order = r.permutation(len(labels))
        for a in range(0, len(order), batch):
            take = order[a : a + batch]
            row = np.repeat(np.arange(len(take)), [len(kept[i]) for i in take])
            at = np.concatenate([kept[i] for i in take])
            margin, total = model._margin(row, at, len(take))
            error = (_sigmoid(margin) - labels[take]) / len(take)
            step += 1
            touched = np.unique(at)
            slot = np.searchsorted(touched, at)
            gw = np.bincount(slot, error[row], len(touched)) + decay * model.weight[touched] / 10
            gv = np.zeros((len(touched), RANK))
            np.add.at(gv, slot, error[row][:, None] * (total[row] - model.factor[at]))
            gv += decay * model.factor[touched] / 10
            for p, g, m, v in zip(params, (gw, gv), first, second, strict=True):
                m[touched] += 0.1 * (g - m[touched])
                v[touched] += 0.01 * (g * g - v[touched])
                p[touched] -= 0.03 * m[touched] / (np.sqrt(v[touched]) + 1e-6)
            model.bias -= 0.05 * error.sum()
    return model


def calibrated(rows: list[np.ndarray], labels: np.ndarray, target: float = 0.7) -> Machine:
    """A fitted machine whose score is ``target`` where the two labels are best told apart.

    Each half of the texts is scored by a machine fitted on the other; the margin
    with the best F1 over all of them is moved to the target.
    """
    model = fit(rows, labels)
    half = np.arange(len(labels)) % 2 == 0
    margins = np.zeros(len(labels))
    if 4 <= labels.sum() <= len(labels) - 4:
        for part in (half, ~half):
            other = fit([r for r, h in zip(rows, part, strict=True) if not h], labels[~part])
            margins[part] = other.margins([r for r, h in zip(rows, part, strict=True) if h])
        order = np.argsort(-margins, kind="stable")
        hits = np.cumsum(labels[order])
        f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
        best = int(f1.argmax())
        below = margins[order[best + 1]] if best + 1 < len(order) else margins[order[best]]
        cut = (margins[order[best]] + below) / 2
        model.bias += float(np.log(target / (1 - target)) - cut)
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_TEXTS) -> Machine:
    """Fit on labelled documents whose crc32 remainder is not 1; a repeated label counts once."""
    known = pick(labels, "doc_id", "toxic", types={"toxic": "int"}).filter("toxic is not null").distinct()
    known = known.filter(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit)
    # At most ``limit`` short rows on the small side; the texts come as sets of hashed terms.
    rows = pick(docs, "doc_id", "text").filter("doc_id is not null").join(F.broadcast(chosen), "doc_id")
    sets = rows.mapInArrow(_term_sets, "doc_id bigint, toxic int, terms binary")
    got = sorted((r["doc_id"], r["toxic"], bytes(r["terms"])) for r in sets.collect())
    return calibrated([np.frombuffer(t, np.int32).astype(np.int64) for *_, t in got], np.array([y for _, y, _ in got], dtype=float))


def _term_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [terms((t or "").encode()).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["doc_id", "toxic", "terms"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Machine = shared.value
        for whole in batches:
            for batch in slices(whole, 1):
                rows = [terms((t or "").encode()) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows), pa.float64())], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, machine: Machine | None = None, cutoff: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Without a machine, one is trained on ``labels`` (doc_id, toxic).  Null and
    empty texts get the score of no terms.  A null doc_id gives a null held_out;
    repeated rows are scored each; an empty table gives no rows; without labels
    every score is the same small one.
    """
    if machine is None:
        machine = train(docs, labels)
    # Known terms only: a few megabytes at most, bounded by BITS and RANK.
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    scored = pick(docs, "doc_id", "text").mapInArrow(_score(shared), "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted")
    )
