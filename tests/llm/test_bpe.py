import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from tidemark.llm import bpe_rank_queue as bpe

with open(P.path(bpe.VOCABULARY), "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.encoder(P.path(bpe.VOCABULARY))
PIECES = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "don't", "é", "ß", "漢字", "🙂", " ", " ", "\x1c", "\x1f", "\0", "\x85", "12", "3.14", "<|endoftext|>", "...", "!!", " the", "ing", "​", "﻿"]


def ids(text):
    return [int.from_bytes(x, "little") for x in zip(*[iter(OWN.encode([text])[0])] * 4)]


def test_random_texts_equal_tiktoken():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choices(PIECES, k=rng.randrange(0, 30)))
        assert ids(text) == TIKTOKEN.encode_ordinary(text), repr(text)


def test_long_pre_tokens_equal_tiktoken():
    rng = random.Random(2)
    for alphabet in ("a", "ab", "abcdefghij", "=-", "é", "漢字かな"):
        text = "".join(rng.choices(alphabet, k=5000))
        assert ids(text) == TIKTOKEN.encode_ordinary(text)


def test_bounded_cache_gives_the_same_ids():
    small = bpe.ChunkIds(lambda texts: list(map(OWN.encode_chunk, texts)), limit=2)
    for i in range(40):
        texts = [f"w{i % 5} w{i % 3}", None, "x" * 100]
        assert small.encode(texts) == [OWN.encode_chunk(t or "") for t in texts]


def test_documents_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe.round_trip(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = TIKTOKEN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "a", 0), (1, None, "a", 0), (None, "", "b", 1), (2, "x " * 20000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, id long")
    out = bpe.round_trip(docs).collect()
    assert sorted((r.n_tokens for r in out)) == [0, 0, 0, len(TIKTOKEN.encode_ordinary("x " * 20000))]
    assert bpe.round_trip(docs.limit(0)).collect() == []
    back = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t, _, _ in rows)
