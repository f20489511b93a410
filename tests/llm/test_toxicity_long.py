import random

import numpy as np
import pyarrow as pa

from tidemark.llm import toxicity_kn as kn


def test_pieces_predict_every_place_of_a_long_word_once():
    rng = random.Random(1)
    for n in (40, 41, 46, 74, 75, 108, 109, 200):
        word = "".join(rng.choices("abcdefgh", k=n))
        codes, sizes, starts = kn._codes(kn._pieces(word))
        assert sizes.max() <= kn.MAX_WORD + 2
        whole = [1, *(ord(c) + 3 for c in word), 2]
        want = [tuple(whole[max(0, p - kn.ORDER + 1) : p + 1]) for p in range(1, len(whole))]
        assert [tuple(int(x) for x in row[max(0, p - kn.ORDER + 1) : p + 1]) for row, size, start in zip(codes, sizes, starts) for p in range(start, size)] == want


def test_words_part_at_punctuation_and_space_of_any_kind():
    words = lambda *texts: kn._words(pa.array(texts)).to_pylist()
    assert words("A b", None, "don't\u3000stop\u2014now\tx") == [["a", "b"], None, ["don", "t", "stop", "now", "x"]]
    assert [w for w in words("a" * 39 + "," + "b" * 39)[0]] == ["a" * 39, "b" * 39]
    assert words("x" * 100)[0] == kn._pieces("x" * 100) and len(words("x" * 100)[0]) == 3


def test_what_an_expression_is_glued_to_by_punctuation_changes_nothing():
    model = kn.KneserNey(["vile", "kind", "river"], np.array([3.0, 0, 1]), np.array([0.0, 4, 1]))
    look = kn._Lookup()
    for n in (3, 9, 30):
        r = look.rows(model, pa.array(["vile", "-".join(["river"] * n + ["vile"])]))
        assert r[1][-1] == r[0][0] and len(r[1]) == n + 1


def test_text_without_ascii_spaces_is_read_to_its_end(spark):
    rng = random.Random(5)
    plain = ["river", "stone", "walks", "green", "evening", "letters", "garden", "quiet"]
    rows = []
    for i in range(300):
        words = rng.choices(plain, k=40)
        if i % 3 == 0:
            words[20:] = ["vex" + "".join(rng.choices("abcdef", k=3)) if k % 4 == 0 else w for k, w in enumerate(words[20:])]
        rows.append((i, ("　", " ", "-", "_", ",")[i % 5].join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = kn.fit(docs.where("doc_id < 200"), docs.where("doc_id < 200"))
    out = kn.score(docs.where("doc_id >= 200"), model).collect()
    assert len(out) == 100 and sum((r.score >= kn.THRESHOLD) != (r.doc_id % 3 == 0) for r in out) <= 1
