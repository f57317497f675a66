import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from colloquy.llm import bpe, token_planes  # noqa: E402
from colloquy.llm.common import scratch  # noqa: E402

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0   　"


def strange_texts(n=3000):
    rnd = random.Random(3)
    letters = "aab  béß字💩1２'s.,!-" + SPACES + "  \n "
    out = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return out + ["a" * 3000, "ab" * 5000, " " * 1000, "é" * 700, "", "\n" * 600 + "x", " lead", "trail \n ", "a<|endoftext|> <|endoftext|>b", "a <|endoftext|> b c", "<|endoftext |> a"]


def test_units_give_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    encode = token_planes.UnitEncoder(JSON, PATTERN, most=500)  # the memory fills and empties on the way
    for t in strange_texts(1500):
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_matrix_merges_equal_tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.TextEncoder(RANKS, PATTERN, most=2000)
    texts = strange_texts()
    for i in range(0, len(texts), 500):
        for t, ids in zip(texts[i : i + 500], encoder(texts[i : i + 500])):
            assert ids.tolist() == own.encode_ordinary(t), repr(t)
            assert encoder.decode(ids.tolist()) == t.encode()


def test_matrix_and_heap_agree():
    matrix = bpe.MatrixBPE(bpe.load_ranks(RANKS))
    rnd = random.Random(5)
    pieces = ["".join(rnd.choice("abetion ") for _ in range(rnd.randint(2, 200))).encode() for _ in range(300)]
    for p, ids in zip(pieces, matrix.encode(pieces)):
        if p not in matrix.rank:
            assert matrix._heap(p).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(0).integers(0, 2**32, 70_001, dtype=np.uint64).astype("<u4")
    for n in (1, 7, 70_001):
        assert (token_planes.from_planes(token_planes.to_planes(ids[:n], bits), n) == ids[:n]).all()


def test_joined_crc():
    parts = [b"abc", b"", b"defgh" * 99, bytes(1000)]
    assert token_planes.crc32_joined([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def expected_ids(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    return [tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in rows]


@pytest.mark.parametrize("block_ids", [64, 1 << 16])
def test_token_file(spark, odd_docs, block_ids):
    strange = [(100 + i, t) for i, t in enumerate(strange_texts(60))]
    odd_docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(strange, "doc_id long, text string"))
    path = scratch(spark, "test-tokens")
    token_planes.write_tokens(odd_docs, path, JSON, PATTERN, block_ids=block_ids, bits=block_ids == 64)
    got = sorted(token_planes.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in odd_docs.collect()], key=lambda d: (d is not None, d))
    at, all_ids = 0, []
    rows = {}
    for r in odd_docs.collect():
        rows.setdefault(r.doc_id, []).append(r)
    for g in got:
        (ids,) = {tuple(x) for x in expected_ids(rows[g.doc_id])}
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        all_ids += ids
    for start, n in ((0, 10), (50, 300), (at - 5, 5)):
        assert token_planes.read_ids(spark, path, start, n).tolist() == all_ids[start : start + n]


def test_token_file_of_nothing(spark, no_docs):
    path = scratch(spark, "test-tokens")
    token_planes.write_tokens(no_docs, path, JSON, PATTERN)
    assert token_planes.read_digests(spark, path).count() == 0


def test_encoded_texts(spark, odd_docs, no_docs):
    assert bpe.encode_texts(no_docs, RANKS, PATTERN).count() == 0
    encoder = bpe.TextEncoder(RANKS, PATTERN)
    want = sorted(((r.doc_id is None, r.doc_id or 0), encoder([r.text])[0].tolist(), r.text or "") for r in odd_docs.collect())
    got = sorted(bpe.encode_texts(odd_docs, RANKS, PATTERN).collect(), key=lambda r: ((r.doc_id is None, r.doc_id or 0), r.ids))
    for (_, ids, text), g in zip(want, got, strict=True):
        assert g.ids == ids and g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
