import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from attestra.llm import ngram_lm

from . import cases


def brute(docs, train, alpha=0.4):
    words, pairs, total = Counter(), Counter(), 0
    split = lambda t: ["<s>", *((t or "").encode().split()), "</s>"]
    for t in train:
        w = split(t)
        words.update(w)
        pairs.update(zip(w, w[1:], strict=False))
        total += len(w) - 1
    out = []
    for i, t in docs:
        w = split(t)
        s = [math.log(pairs[a, b] / words[a]) if pairs[a, b] else math.log(alpha) + math.log((words[b] or 0.5) / max(total, 1)) for a, b in zip(w, w[1:], strict=False)]
        out.append((i or -1, len(s), pytest.approx(sum(s), rel=1e-9, abs=1e-9)))
    return sorted(out, key=lambda x: x[:2])


def rows(n):
    rng = random.Random(n)
    return [(k, " ".join(rng.choice("the of a b c d e f g h".split()) for _ in range(rng.randint(0, 40))), "en", 0.0) for k in range(n)]


@pytest.mark.parametrize("size", [30, 200, 1_000_000])  # with frequent pairs, with frequent words, without
def test_scores_match_brute_force(spark, size):
    data = rows(60) + cases.ODD
    got = sorted(((r.doc_id or -1, r.n_pairs, r.score) for r in ngram_lm.scores(spark.createDataFrame(data, cases.TEXT), size=size).collect()), key=lambda x: x[:2])
    assert got == brute([(i, t) for i, t, _, _ in data], [t for _, t, _, _ in data])


@pytest.mark.parametrize("size", [10, 200, 1_000_000])
def test_unseen_pairs_back_off(spark, size):
    data, train = rows(50) + [(90, "never seen words here", "en", 0.0)], rows(20)
    found = ngram_lm.scores(spark.createDataFrame(data, cases.TEXT), spark.createDataFrame(train, cases.TEXT), size=size)
    got = sorted(((r.doc_id or -1, r.n_pairs, r.score) for r in found.collect()), key=lambda x: x[:2])
    assert got == brute([(i, t) for i, t, _, _ in data], [t for _, t, _, _ in train])


def test_a_pair_in_most_documents_is_not_shuffled(spark):
    data = [(k, f"the end {k}", "en", 0.0) for k in range(300)]
    docs = spark.createDataFrame(data, cases.TEXT)
    hot = ngram_lm.Hot(np.array([xxhash.xxh64_intdigest(b"the"), xxhash.xxh64_intdigest(b"end"), ngram_lm.START], np.uint64), np.full(3, 300))
    counts = {r.code: r.n for r in ngram_lm.hot_pairs(docs, hot).collect()}
    assert sorted(counts.values()) == [300, 300]
    hot.pairs, hot.pair_counts = np.array(sorted(counts)), np.array([300, 300])
    bodies = [ngram_lm._unpack(r.body) for r in ngram_lm.pair_blocks(docs, False, hot, 4).where("part >= 0").collect()]
    assert sum(len(b[4]) for b in bodies) == 600  # "end k" and "k </s>" alone


def test_empty_and_clashing(spark):
    assert ngram_lm.scores(cases.empty(spark)).count() == 0
    assert ngram_lm.scores(cases.clashing(spark)).count() == 1
    assert ngram_lm.scores(spark.createDataFrame(rows(5), cases.TEXT), cases.empty(spark)).count() == 5
