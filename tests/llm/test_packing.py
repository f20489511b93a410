import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing as pk

TOKENIZER = Tokenizer.from_file(P.path(pk.VOCABULARY))


def check(rows, texts, capacity=1024):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_bin)


@pytest.mark.parametrize("per_partition", [200_000, 40])
def test_documents(spark, sf, per_partition):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pk.pack(docs, per_partition=per_partition).collect()
    bins = check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert bins <= (1.03 if per_partition > 1000 else 1.06) * pk.lower_bound(np.array([r.length for r in rows]))


def test_tokens_equal_the_library_on_odd_white_space():
    rng, own = random.Random(3), pk.TokenIds(P.path(pk.VOCABULARY))
    bits = ["a", " ", "  ", "\n", "\n\n", "\t", " b", "'s", "é", " ", "\x1c", "\0", "<|endoftext|>", "12", "!?"]
    for _ in range(1500):
        text = "".join(rng.choices(bits, k=rng.randrange(20)))
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text)


def test_lower_bound_is_one(tmp_path):
    rng = np.random.default_rng(0)
    for capacity in (12, 30):
        for _ in range(60):
            lengths = rng.integers(1, capacity + 1, 7)
            best = exact(sorted(lengths.tolist(), reverse=True), capacity)
            bins = pk.best_fit_decreasing(lengths, capacity)
            assert pk.lower_bound(lengths, capacity) <= best <= bins.max() + 1
            assert np.bincount(bins, lengths).max() <= capacity
    assert pk.lower_bound(np.array([600] * 10), 1024) == 10


def exact(lengths, capacity):
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "alpha beta", None), (3, "word " * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = pk.pack(docs).collect()
    assert sum(r.length for r in out) == 1 + 1 + 1 + 3 + len(TOKENIZER.encode("word " * 5000, add_special_tokens=False).ids) + 1
    assert sum(r.doc_id is None for r in out) == 1 and sum(r.doc_id == 2 for r in out) == 2
    assert pk.pack(docs.limit(0)).collect() == []


def test_strings_of_special_tokens_get_their_ids():
    own = Tokenizer.from_file(P.path(pk.VOCABULARY))
    texts = ["hi <|endoftext|> there", "plain", None, "", "<|endoftext|>", "a" + "".join(t.content for t in own.get_added_tokens_decoder().values()) + " b", "<|endof text|>"]
    got = pk.TokenIds(P.path(pk.VOCABULARY)).encode(texts)
    for text, ids in zip(texts, got):
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == own.encode(text or "", add_special_tokens=False).ids
