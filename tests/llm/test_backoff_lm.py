import math
import random
from collections import Counter

import pytest

from attestra.llm import backoff_lm

from . import cases


def brute(texts, order, alpha=0.4):
    every = [["<s>", *(t or "").split(), "</s>"] for t in texts]
    grams = lambda ws: Counter(tuple(ws[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(1, len(ws)) if i - n + 1 >= 0)
    whole, out = sum(map(grams, every), Counter()), []
    for ws in every:
        c = whole - grams(ws)
        contexts = Counter()
        for g, n in c.items():
            contexts[g[:-1]] += n
        score = off = 0
        for i in range(1, len(ws)):
            n, drops = min(order, i + 1), 0
            while n > 1 and not c[tuple(ws[i - n + 1 : i + 1])]:
                n, drops = n - 1, drops + 1
            g = tuple(ws[i - n + 1 : i + 1])
            score += math.log(alpha) * drops + math.log((c[g] or 0.5) / max(contexts[g[:-1]], 1))
            off += drops > 0
        out.append((len(ws) - 1, pytest.approx(score), off))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_held_out_backoff(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 12))) for _ in range(30)] + [None, "qq ww ee rr", "a b c", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.score, r.n_backed_off) for r in backoff_lm.scores(docs, order).collect()}
    assert got == dict(enumerate(brute(texts, order)))


def test_made_up_words_are_unlikely(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the cat sat on the rug"), (3, "zq xv wk pj vv yy")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in backoff_lm.scores(docs).collect()}
    assert got[3] < got[1] and got[3] < got[2]


def test_odd_rows(spark):
    assert backoff_lm.scores(cases.odd(spark)).count() == len(cases.ODD)
    assert backoff_lm.scores(cases.empty(spark)).count() == 0
