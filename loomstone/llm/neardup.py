"""MinHash near-deduplication.

1. One-permutation hashing: each document's distinct word shingles are hashed
   once into bins, every bin keeps its minimum, and empty bins borrow from
   others by a hash of (bin, attempt), which keeps collisions unbiased.
2. Bands of the signature are buckets.  A bucket proposes a star: its smallest
   member with each other, so n members make n - 1 candidate pairs.
3. Candidates are confirmed on the full sets; links make components.
4. A star can miss a link between two members that both differ from the hub.
   Buckets that still hold several components are compared in blocks, members
   outside the bucket's largest component against all, without listing pairs.

Texts with equal sets are one node throughout, so thousands of copies cost one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.columns import pick
from loomstone.llm.components import components
from loomstone.llm.textarrays import column_bytes, mix, shingle_sets, slices
from loomstone.runtime import drop_table, persist_table

ROWS, BANDS = 4, 40
SHINGLE = 5
BLOCK = 256
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(made: np.ndarray, bounds: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """The bucket keys (documents x bands, int64) of sets of hashes; an empty set has the same key everywhere."""
    u = np.uint64
    k, n = rows * bands, len(bounds) - 1
    counts = np.diff(bounds)
    hashed = mix(made ^ u(0x5DEECE66D1234567))
    bins = ((hashed >> u(32)) * u(k)) >> u(32)
    minima = np.full(n * k, _EMPTY)
    np.minimum.at(minima, np.repeat(np.arange(n), counts) * k + bins.astype(np.int64), hashed & u(0xFFFFFFFF))
    lent = minima.copy()
    missing = np.flatnonzero(minima == _EMPTY)
    missing = missing[counts[missing // k] > 0]
    attempt = 0
    while len(missing):
        attempt += 1
        at = (missing % k).astype(np.uint64)
        donor = ((mix(at * u(0x9E3779B97F4A7C15) + u(attempt)) >> u(32)) * u(k)) >> u(32)
        value = minima[missing - missing % k + donor.astype(np.int64)]
        found = value != _EMPTY
        lent[missing[found]] = value[found]
        missing = missing[~found]
    turn = mix(np.arange(101, 101 + rows, dtype=np.uint64)) | u(1)
    keys = (lent.reshape(n, bands, rows) * turn).sum(axis=2, dtype=np.uint64)
    return mix(keys + mix(np.arange(1, bands + 1, dtype=np.uint64))).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            made, bounds = shingle_sets(*column_bytes(batch.column(1)), SHINGLE)
            keys = signatures(made, bounds)
            totals = [np.concatenate([[np.uint64(0)], np.cumsum(mix(made ^ np.uint64(s)))]) for s in (7, 77)]
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(bounds), pa.int64()),
                    *(pa.array((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64), pa.int64()) for t in totals),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                a, a_at = shingle_sets(*column_bytes(batch.column(2)), SHINGLE)
                b, b_at = shingle_sets(*column_bytes(batch.column(3)), SHINGLE)
                yes = [
                    _linked(a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]], percent) for i in range(batch.num_rows)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(
                    pa.array(yes, pa.bool_())
                )

    return run


def _block_links(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between different components among (role 1 or 2) x (role 0 or 2) rows of a block."""
        ids, comps, role = group["node"].to_numpy(), group["component"].to_numpy(), group["role"].to_numpy()
        made, bounds = shingle_sets(*column_bytes(pa.array(group["text"], pa.large_string())), SHINGLE)
        sizes = np.diff(bounds)
        values, inverse, seen = np.unique(made, return_inverse=True, return_counts=True)
        shared = seen > 1
        column = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(ids)), sizes)
        use = shared[inverse]
        row, column = row[use], column[inverse[use]]
        asks, members = np.flatnonzero(role > 0), np.flatnonzero(role != 1)
        both = np.zeros((len(asks), len(members)), dtype=np.float32)
        width = 4096
        for low in range(0, int(shared.sum()), width):  # the incidence matrix in slices of columns
            part = (column >= low) & (column < low + width)
            incidence = np.zeros((len(ids), width), dtype=np.float32)
            incidence[row[part], column[part] - low] = 1
            both += incidence[asks] @ incidence[members].T
        union = sizes[asks][:, None] + sizes[members][None, :] - both
        hit = (100 * both >= percent * union) & (comps[asks][:, None] != comps[members][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                x = p
            return x

        out = []
        for i, j in np.argwhere(hit):
            a, b = root(comps[asks[i]]), root(comps[members[j]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((ids[asks[i]], ids[members[j]]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _by_size(members: DataFrame, percent: int) -> DataFrame:
    """Buckets cut by set size, as new buckets in which every pair that can be linked still meets.

    Sizes of linked sets differ by 100 / percent at most.  Powers of a ratio just
    above it bound the classes, so such a pair lies in one class or in two
    neighbours; every member stands in the bucket of its class and of the one below.
    """
    level = F.floor(F.ln(F.col("n_shingles").cast("double")) / F.ln(F.lit(1.001 * 100 / percent)))
    return members.select(
        F.explode(F.array(level, level - 1)).alias("level"), "bucket", "node", "component"
    ).select(F.xxhash64("bucket", "level").alias("bucket"), "node", "component")


def _unresolved(members: DataFrame, labels: DataFrame, percent: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(bucket, i, j, node, component, role): the blocks of buckets that hold several components.

    keep: writes a table.  Aggregates are written before rows are joined with
    them, so that a bucket with many members is no single task's.
    """
    named = members.join(labels, "node", "left").select(
        "bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    named = keep(_by_size(named.join(keep(mixed.select("bucket"), "mixed"), "bucket", "left_semi"), percent), "by-size")
    size = named.groupBy("bucket").agg(
        F.count("*").alias("m"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    # Two members were compared by the star; bands with the same members need one comparison.
    open_ = size.filter("low < high and m > 2").groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket"))
    rows = keep(named.join(keep(open_.select("bucket", "m"), "open"), "bucket"), "open-rows")
    largest = keep(
        rows.groupBy("bucket", "component").agg(F.count("*").alias("c"))
        .groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("top")),
        "largest",
    )
    rows = rows.join(largest, "bucket").select(
        "bucket", "node", "component", "m",
        (F.col("component") != F.col("main")).alias("asks"),
        F.ceil(F.col("m") / BLOCK).cast("int").alias("nj"),
        F.ceil((F.col("m") - F.col("top")) / BLOCK).cast("int").alias("ni"),
    )
    one = rows.filter("nj = 1").select(
        "bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "component",
        F.when(F.col("asks"), 2).otherwise(0).alias("role"),
    )
    many = rows.filter("nj > 1")
    spread = F.xxhash64("node")
    as_member = many.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"),
        F.pmod(spread, F.col("nj").cast("bigint")).cast("int").alias("j"), "node", "component", F.lit(0).alias("role"),
    )
    as_query = many.filter("asks").select(
        "bucket", F.pmod(spread, F.col("ni").cast("bigint")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), "node", "component", F.lit(1).alias("role"),
    )
    return one.unionByName(as_member).unionByName(as_query)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their sets of distinct shingles of five words (A-Z lower-cased, words split
    at ASCII white space; fewer words make one shingle).  ``component_id`` is
    the smallest doc_id reachable by links, ``kept`` says that it is the row's
    own.  Null, empty and blank texts have n_shingles 0 and are linked with
    nothing.  A null doc_id takes no part: component_id is null and kept true.
    Rows that share a doc_id count as one node with the links of each.  An empty
    table gives no rows.

    A pair at the threshold shares no bucket with a chance of about 3e-7, less
    when it is more alike.  Shuffled are the band keys of distinct texts and the
    texts of those that share a bucket; no step gathers a bucket in one task.
    """
    rows = pick(docs, "doc_id", "text")
    signed = persist_table(
        rows.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"),
        "signed",
    )
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    # Written first, so that the join below stands alone and Spark may split a set with many copies.
    sets = persist_table(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "sets")
    named = persist_table(
        full.join(sets, ["set_a", "set_b"]).select(
            "doc_id", "n_shingles", "node", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands")
        ),
        "named",
    )
    buckets = named.filter("doc_id = node").select("node", "n_shingles", F.explode("bands").alias("bucket"))
    scratch: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        scratch.append(persist_table(df, name))
        return scratch[-1]

    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
    members = keep(buckets.join(keep(hubs.select("bucket", "hub"), "hubs"), "bucket"), "members")
    active = members.select("node").distinct()
    texts = keep(
        rows.filter("doc_id is not null").join(active, rows.doc_id == active.node).select("node", "text"), "texts"
    )
    pairs = members.filter("node != hub").select("hub", "node").distinct()
    found = (
        pairs.join(texts, "node")
        .withColumnRenamed("text", "member_text")
        .join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
        .select("hub", "node", "hub_text", "member_text")
        .mapInArrow(_verifier(percent), "u bigint, v bigint")
    )
    links = keep(found, "links")
    labels = components(links)
    blocks = _unresolved(members.select("bucket", "node", "n_shingles").distinct(), labels, percent, keep)
    more = keep(
        blocks.join(texts, "node")
        .groupBy("bucket", "i", "j")
        .applyInPandas(_block_links(percent), "u bigint, v bigint"),
        "more-links",
    )
    if not more.isEmpty():
        scratch.append(labels)
        labels = components(links.unionByName(more))
    for t in scratch:
        drop_table(t)
    linked = named.join(labels.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")
    )
    alone = signed.filter("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
