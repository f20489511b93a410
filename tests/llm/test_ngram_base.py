import math
import re
import zlib
from collections import Counter

from tidemark.llm import ngram_trie as lm


def test_base_is_the_add_one_unigram(spark):
    rows = [(i, f"a b w{i % 7} a") for i in range(40)] + [(99, "unseen words")]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: re.findall(r"\S+", t) + [None]
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    # over the known words and one unknown, the probabilities sum to 1
    p = lambda w: (c[w] + 1) / (n + 1 * (v + 1))
    assert abs(sum(map(p, c)) + p("?") - 1) < 1e-12
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        want = sum(math.log10(p(w)) for w in words(dict(rows)[r.doc_id]))
        assert abs(r.base_score - want) < 1e-9 * abs(want)
