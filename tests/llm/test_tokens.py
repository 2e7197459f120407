import random
import zlib

import numpy as np
import pytest

from loomstone.llm import packing, tokenbin
from loomstone.llm.queries import tokenizer_path
from loomstone.llm.tokenizing import Encoder


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_pieces_equal_the_library(encoder, plain):
    bits = [" ", "  ", "\n", "\t", "a", "'s", "'", "é", "ß", "×", "ª", "1", "²", "!", " ", " ", "漢", "\u2028", "\u3000", "\xa0", "\x85", "\x1c", "😀", "\r\n", "<|endoftext|>", "der", "10"]
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        assert encoder.ids(text).tolist() == plain(text), repr(text)


def test_added_tokens_are_the_librarys(encoder, plain):
    end = "<|endoftext|>"
    bits = [end, end[:-1], end[1:], end, " ", "\n", "a", "word", " word", "1", "漢", "<|", "|>", "  "]
    rng = random.Random(4)
    texts = [end, end * 3, f"a{end}b", f" {end} ", f"{end}\n", f"x {end}"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(5000)]
    for text in texts:
        assert encoder.ids(text).tolist() == plain(text), repr(text)
    assert encoder.ids(f"hi {end} there").tolist().count(50256) == 1


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    packed = tokenbin.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    for a, b in [(0, 1000), (0, 0), (7, 9), (333, 1000)]:
        assert tokenbin.unpack(packed, bits, a, b).tolist() == ids[a:b].tolist()


def test_width():
    assert [tokenbin.width(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


ROWS = [(3, "a b c", "x"), (1, None, "y"), (2, "", None), (None, "no id", "z"), (2, "twice", "z"), (9, "word " * 5000, "z")]


def test_token_files(spark, plain, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, start string").repartition(3)
    path = str(tmp_path / "t")
    tokenbin.write_tokens(docs, path, tokenizer_path(), block_ids=4)
    got = sorted(tokenbin.token_digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3, 9]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    by = {(r["doc_id"], r["n_tokens"]): r["ids_crc32"] for r in got}
    for doc_id, text, _ in ROWS:
        ids = np.array([*plain(text), 0], dtype="<u4")
        assert by[doc_id, len(ids)] == zlib.crc32(ids.tobytes())
    ids = {r["doc_id"]: r["ids"] for r in tokenbin.read_tokens(spark, path).collect() if r["doc_id"] == 3}
    assert ids[3] == [*plain("a b c"), 0]
    stream = [i for r in got for i in next(x["ids"] for x in tokenbin.read_tokens(spark, path).collect() if x["doc_id"] == r["doc_id"] and len(x["ids"]) == r["n_tokens"])]
    for a, b in [(0, len(stream)), (1, 2), (3, 9), (7, 5000), (len(stream), len(stream) + 5)]:
        parts = sorted(map(tuple, tokenbin.read_range(spark, path, a, b).collect()))
        assert [i for _, ids in parts for i in ids] == stream[a:b]
    wanted = tokenbin.read_documents(spark, path, [2, 9, 77])
    assert sorted((r["doc_id"], len(r["ids"])) for r in wanted.collect()) == [(2, 1), (2, 3), (9, len(plain("word " * 5000)) + 1)]
    assert "first_id" in wanted._jdf.queryExecution().toString().split("PushedFilters")[1][:120]


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokenbin.token_round_trip(docs, tokenizer_path()).count() == 0
    assert packing.pack_documents(docs, tokenizer_path()).count() == 0


def test_pieces_are_binary():
    for n in [1, 2, 3, 2047, 2048, 2049, 10_000]:
        got = packing.pieces(n, 2048)
        assert sum(length for _, length in got) == n
        assert all(length & (length - 1) == 0 and length <= 2048 for _, length in got)
        assert [s for s, _ in got] == [sum(x for _, x in got[:i]) for i in range(len(got))]


def test_packing(spark, plain):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, start string").repartition(3)
    got = packing.pack_documents(docs, tokenizer_path(), longest=64, with_ids=True).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["offset"] == 0 and r["length"] == len(r["ids"]) == 1 << r["bucket"] for r in got)
    for doc_id, text, _ in ROWS:
        want = [*plain(text), 1]
        mine = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == doc_id and r["doc_tokens"] == len(want))
        assert [i for _, ids in mine for i in ids] == want
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
    with pytest.raises(ValueError):
        packing.pack_documents(docs, tokenizer_path(), longest=100)
