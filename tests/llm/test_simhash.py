import re

import xxhash

from tidemark.llm import simhash_covering as sh

SCHEMA = "doc_id long, text string, fp string, component string"


def brute(rows):
    prints = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
        h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
        prints.append((doc, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(prints)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(sh.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_ties_clashing_names_and_repeats(spark):
    long = " ".join(f"w{i % 97}" for i in range(5000))
    rows = [(3, None), (1, ""), (2, " \n\t"), (4, "One TWO"), (9, "one two"), (9, "one two"), (None, "one two"), (7, long), (8, long + " x"), (None, "alone")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    assert got(sh.near_duplicates(docs)) == brute(rows)


def test_chains_of_near_fingerprints(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    prints = set(centres)
    for c in centres:
        for _ in range(40):
            for b in rng.integers(0, 63, rng.integers(1, 4)):
                c ^= 1 << int(b)
            prints.add(c)
    prints = sorted(prints)
    edges = sh.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    found = {r.node: r.component for r in sh.components(edges).collect()}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {p: found.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_empty_table(spark):
    assert got(sh.near_duplicates(spark.createDataFrame([], SCHEMA))) == []


def test_masks_cover_every_pair_within_the_radius():
    masks = sh.masks(2)
    for i in range(64):
        for j in range(i, 64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def test_texts_of_many_chunks_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for size in (300, 5000):
        assert got(sh.near_duplicates(docs.coalesce(1), chunk_bytes=size)) == want
    big = [(i, " ".join(f"Ä{(i // 2) * 7 + j % 991} Bx" for j in range(120_000))) for i in range(6)]
    assert got(sh.near_duplicates(spark.createDataFrame(big, "doc_id long, text string").coalesce(1))) == brute(big)
