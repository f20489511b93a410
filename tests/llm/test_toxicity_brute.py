import math
import random
from collections import Counter

import numpy as np

from tidemark.llm import toxicity_kn as kn


def brute(words, counts, order, alphabet):
    """log P(word | class) of any word, by the definition: counts of the class for the longest context, shared continuation types below."""
    codes = lambda w: (1, *(ord(c) + 3 for c in w), 2)
    top, context, kinds = Counter(), Counter(), {}
    types: list[set] = [set() for _ in range(order - 1)]
    for w, n in zip(words, counts):
        c = codes(w)
        for p in range(1, len(c)):
            k = min(p, order - 1)
            if n:
                gram = c[p - k : p + 1]
                top[gram] += n
                context[gram[:-1]] += n
                kinds.setdefault(gram[:-1], set()).add(gram)
    for w in words:  # of either class
        c = codes(w)
        for p in range(1, len(c)):
            for size in range(min(p, order - 1) + 1 if p < order - 1 else order - 1):
                types[size].add((c[p - size : p + 1], c[max(p - size - 1, 0) : p + 1]))
    shared = []
    for own in types:
        count, total, distinct = Counter(), Counter(), {}
        for gram, _ in own:
            count[gram] += 1
            total[gram[:-1]] += 1
            distinct.setdefault(gram[:-1], set()).add(gram)
        shared.append((count, total, distinct))

    def logp(word):
        c, out = codes(word), 0.0
        for p in range(1, len(c)):
            k = min(p, order - 1)
            value = 1 / alphabet
            for size in range(k):
                count, total, distinct = shared[size]
                h = c[p - size : p]
                if total[h]:
                    value = max(count[c[p - size : p + 1]] - kn.DISCOUNT, 0) / total[h] + kn.DISCOUNT * len(distinct[h]) / total[h] * value
            h = c[p - k : p]
            if context[h]:
                value = max(top[c[p - k : p + 1]] - kn.DISCOUNT, 0) / context[h] + min(kn.DISCOUNT * len(kinds[h]), context[h]) / context[h] * value
            out += math.log(value)
        return out

    return logp


def test_ratios_are_those_of_the_definition():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(60)})
    toxic, ordinary = ([rng.choice((0, 0, 1, 2, 5)) for _ in words] for _ in range(2))
    some = [i for i in range(len(words)) if toxic[i] + ordinary[i]]
    words, toxic, ordinary = ([x[i] for i in some] for x in (words, toxic, ordinary))
    for order in (2, 4, 7):
        model = kn.KneserNey(words, np.array(toxic, float), np.array(ordinary, float), order)
        t, o = (brute(words, c, order, model.alphabet) for c in (toxic, ordinary))
        asked = [*words, "zzz", "", "abcdabcdabcd", "a"]
        got = model.ratios(asked)
        assert np.allclose(got, [t(w) - o(w) for w in asked], atol=1e-5), order
