import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from seekloom.llm import lm


def brute(texts):
    docs = {k: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b"</s>"] for k, t in texts.items()}
    train = [w for k, w in docs.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    c, pairs = Counter(x for w in train for x in w), Counter(p for w in train for p in zip([b"<s>", *w], w))
    n, v, types, all_types = sum(c.values()), len(c), Counter(b for _, b in pairs), len(pairs)
    of = lambda counter: [sum(x == k for x in counter.values()) for k in (1, 2, 3, 4)]
    d, d1 = lm.discounts(*of(pairs)), lm.discounts(*of(types))
    g1 = sum(d1[min(x, 3) - 1] for x in types.values()) / all_types if all_types else 1.0
    total, gamma = Counter(), defaultdict(float)
    for (a, _), x in pairs.items():
        total[a] += x
        gamma[a] += d[min(x, 3) - 1]

    def p(a, b):
        low = g1 / (v + 1) + (max(0, types[b] - d1[min(max(types[b], 1), 3) - 1]) / all_types if all_types else 0)
        if not total[a]:
            return low
        return max(0, pairs[a, b] - d[min(max(pairs[a, b], 1), 3) - 1]) / total[a] + gamma[a] / total[a] * low

    return {k: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(a, x)) for a, x in zip([b"<s>", *w], w))) for k, w in docs.items()}


TEXTS = [None, "", "a b a b c", "The cat the CAT sat", "x " * 3000, "é è é", "a\x0bb c", "new words only here", *["the cat sat on the mat again %d" % (k % 5) for k in range(60)]]


def test_against_brute_force(documents):
    got = lm.op8_lm(documents(TEXTS, extra=True)).collect()
    want = brute(dict(enumerate(TEXTS)))
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_counts_above_a_byte_and_no_training_text(documents, spark):
    frame = documents(["b c " * 400] * 3)
    assert {round(r.score, 6) for r in lm.op8_lm(frame).collect()} == {round(brute({0: "b c " * 400, 1: "b c " * 400, 2: "b c " * 400})[0][4], 6)}
    assert lm.op8_lm(frame.limit(0)).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    assert lm.op8_lm(documents(["x y"], ids=[held])).first().score == 0
