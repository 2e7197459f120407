"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are the binary parts of n:
as many whole sequences as fit, then one piece for each set bit of the rest.
Pieces of one length make a bucket, each piece is a sequence of its own, and a
batch drawn from a bucket needs no padding and crosses no document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomstone.llm.columns import pick
from loomstone.llm.textarrays import slices
from loomstone.llm.tokenizing import worker_encoder

PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, bucket int"
)


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids, longest first; ``longest`` is a power of two."""
    out = [(i * longest, longest) for i in range(n // longest)]
    at, rest = n - n % longest, n % longest
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def _packer(tokenizer_path: str, end_id: int, longest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        # A task numbers its own range of sequences; a task that is repeated gives the same numbers.
        sequence = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows, ids_out = [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in pieces(n, longest):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(part), n, sequence, 0, length.bit_length() - 1))
                    sequence += 1
                    if with_ids:
                        ids_out.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            arrays = [pa.array(c, pa.int32() if k == 7 else pa.int64()) for k, c in enumerate(columns)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, longest: int = 2048, with_ids: bool = False
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids].

    ``bucket`` is the power of two of the length.  Null and empty texts give one
    piece that holds the end id.  Repeated rows are packed each; a null doc_id
    stays null; an empty table gives no rows.  No shuffle: each task reads its
    part of the table once.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = PIECE_SCHEMA + (", ids array<bigint>" if with_ids else "")
    return pick(docs, "doc_id", "text").mapInArrow(_packer(tokenizer_path, end_id, longest, with_ids), schema)


def write_buckets(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    """Write the sequences with their ids, one folder for each length."""
    pack_documents(docs, tokenizer_path, with_ids=True, **options).write.partitionBy("bucket").parquet(path)
