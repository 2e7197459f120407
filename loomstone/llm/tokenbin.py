"""Token-id files with fixed-width bit packing.

A dataset is a folder of Parquet files whose rows are *blocks*.  A block holds
the ids of some whole documents, each id in the fewest bits that hold the
vocabulary, packed little-endian into ``payload``; ``doc_ids`` and ``n_tokens``
give the documents in order, and ``shard``/``block_start`` where the block lies
in the stream.  Any block can be unpacked alone, and within it any id range, so
access is random; unpacking is vectorised.  Spark's commit protocol writes the
files, so a lost executor only repeats its tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.columns import pick
from loomstone.llm.tokenizing import worker_encoder
from loomstone.runtime import scratch_path

BLOCK_IDS = 1 << 16
#: Ids that are spread into bits at once.
_SLICE = 1 << 13
BLOCK_SCHEMA = (
    "shard int, block int, block_start bigint, bits int, n_ids bigint, first_id bigint, last_id bigint, "
    "doc_ids array<bigint>, n_tokens array<bigint>, payload binary"
)


def width(vocab_size: int) -> int:
    """The fewest bits that hold every id below ``vocab_size``."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack ids into ``bits`` bits each, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    # Eight ids fill a whole number of bytes, so slices of a multiple of eight can be packed one after the other.
    out = bytearray()
    for low in range(0, len(ids), _SLICE):
        part = ids[low : low + _SLICE].astype("<u4")
        flat = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        out += np.packbits(flat.ravel(), bitorder="little").tobytes()
    return bytes(out)


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop`` of a packed block, reading only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", stop - start, start * bits // 8).astype("<u4")
    first, last = start * bits // 8, -(-stop * bits // 8)
    skip = start * bits - first * 8
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    flat = flat[skip : skip + (stop - start) * bits].reshape(-1, bits).astype(np.uint32)
    return (flat << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _writer(tokenizer_path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        bits = width(max(encoder.vocab_size, end_id + 1))
        end = np.array([end_id], dtype="<u4").tobytes()
        shard = TaskContext.get().partitionId()
        docs, lengths, parts, held, block, start = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([bits], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([next((d for d in docs if d is not None), None)], pa.int64()),
                    pa.array([docs[-1]], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([pack(ids, bits)], pa.binary()),
                ],
                names=["shard", "block", "block_start", "bits", "n_ids", "first_id", "last_id", "doc_ids", "n_tokens", "payload"],
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1).to_pylist()), strict=True):
                docs.append(doc_id)
                parts += (ids, end)
                lengths.append(len(ids) // 4 + 1)
                held += lengths[-1]
                if held >= block_ids:
                    yield flush()
                    docs, lengths, parts, block, start, held = [], [], [], block + 1, start + held, 0
        if docs:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, block_ids: int = BLOCK_IDS
) -> None:
    """Encode ``docs`` (doc_id, text) and write a dataset at ``path`` in ascending doc_id order.

    Null and empty texts hold just the end id.  Rows with equal doc_id keep an
    order given by their text; rows with a null doc_id come first.  An empty
    table writes an empty dataset.  A text of any length lies in one block.
    """
    rows = pick(docs, "doc_id", "text")
    # One shuffle of the texts; files come out in id order, each file a range.
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_writer(tokenizer_path, end_id, block_ids), BLOCK_SCHEMA).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: how many ids of the whole dataset lie before each."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row a file: small whatever the data's size.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = shards.select(
        "shard",
        (F.sum("shard_ids").over(Window.orderBy("shard")) - F.col("shard_ids")).alias("shard_start"),
    )
    return blocks.join(F.broadcast(before), "shard").withColumn("start", F.col("shard_start") + F.col("block_start"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
            ends = np.cumsum(np.array(row["n_tokens"], dtype=np.int64))
            starts = ends - np.array(row["n_tokens"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["start"], pa.int64()),
                    pa.array(row["n_tokens"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    blocks = read_blocks(spark, path).select("bits", "n_ids", "doc_ids", "n_tokens", "payload", "start")
    return blocks.mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
            cuts = np.concatenate([[0], np.cumsum(np.array(row["n_tokens"], dtype=np.int64))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int64)))],
                names=["doc_id", "ids"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The ids themselves: doc_id, ids array<bigint> with the end id."""
    blocks = read_blocks(spark, path).select("bits", "n_ids", "doc_ids", "n_tokens", "payload")
    return blocks.mapInArrow(_expand, "doc_id bigint, ids array<bigint>")


def _ranges(start: int, stop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(start - row["start"], 0), min(stop - row["start"], row["n_ids"])
                ids = unpack(row["payload"], row["bits"], a, b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["start"] + a], pa.int64()), pa.array([ids.astype(np.int64).tolist()], pa.list_(pa.int64()))],
                    names=["start", "ids"],
                )

    return run


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids) for each block that holds ids ``start`` to ``stop`` of the stream; only their bytes of a block are unpacked.

    Blocks outside are left out by their numbers, before their payloads are read from the columnar files.
    """
    near = read_blocks(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return near.select("bits", "n_ids", "payload", "start").mapInArrow(_ranges(start, stop), "start bigint, ids array<bigint>")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents, every row of each; blocks whose range of doc_id holds none are not read.

    Files are in doc_id order, and ``first_id`` and ``last_id`` have statistics in their footers.
    """
    inside = F.lit(False)
    for i in doc_ids:
        inside = inside | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).filter(inside)
    rows = blocks.select("bits", "n_ids", "doc_ids", "n_tokens", "payload").mapInArrow(_expand, "doc_id bigint, ids array<bigint>")
    return rows.filter(F.col("doc_id").isin(doc_ids))


def token_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``docs`` to a fresh dataset in the shared folder and digest what the files hold."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return token_digests(docs.sparkSession, path)
