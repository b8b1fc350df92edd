"""Runs against their definition, and collapsed texts."""

import hashlib
import os
import random
import time
import zlib
from pathlib import Path

import pytest

from attestra.llm import periodic, queries

from . import cases

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def brute(w, least=12):
    """Maximal stretches of each period that no smaller period has too."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(least, 2 * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.append((i, len(s), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(w, runs):
    return [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]


@pytest.mark.parametrize("least", [2, 12])
def test_against_the_definition(least):
    rng = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 6)):
            k = rng.choice((1, 2, 3, 5, 20))
            w = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
            if w and rng.random() < 0.5:
                a, p = rng.randrange(len(w)), rng.randint(1, 10)
                w = [w[min(len(w) - 1, i if i < a else a + (i - a) % p)] for i in range(len(w))]
            texts.append(w)
        assert periodic.runs_of(texts, least) == [brute(w, least) for w in texts]


def test_fibonacci_words_have_very_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert periodic.runs_of([b], 2) == [brute(b, 2)]


def test_a_long_text_is_fast():
    rng = random.Random(3)
    for n, p in ((300_000, 4_000), (300_000, 1), (300_000, 300_000)):
        base = [rng.randrange(5_000) for _ in range(p)]
        began = time.time()
        found = periodic.runs_of([[base[i % p] for i in range(n)]])[0]
        assert time.time() - began < 30
        assert ((0, n, p) in found) == (2 * p <= n)


def test_runs_and_collapsed_texts(spark):
    text = "x " + "a b c\t" * 5 + "a\ny " + "na " * 12 + "batman"
    rows = [(1, text), (2, "no run here"), (3, None), (1, text)]
    out = periodic.collapsed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 4
    assert [tuple(r) for r in by[1].runs] == [(1, 16, 3), (18, 12, 1)]
    assert by[1].collapsed == "x a b c y na batman"
    assert (by[2].runs, by[2].collapsed) == ([], "no run here")
    assert (by[3].runs, by[3].collapsed) == ([], "")


def test_odd_rows_empty_tables_and_clashing_names(spark):
    out = {r.doc_id: r for r in periodic.collapsed(cases.odd(spark)).collect()}
    assert len(out) == len({r[0] for r in cases.ODD})
    words = cases.LONG.split()
    assert [tuple(r) for r in out[7].runs] == [(0, len(words), 16)]
    assert out[7].collapsed == " ".join(words[:16])
    assert periodic.collapsed(cases.empty(spark)).count() == 0
    assert periodic.collapsed(cases.clashing(spark)).count() == 1


@pytest.mark.skipif(not DATA.exists(), reason="the benchmark tables are not here")
def test_the_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for i, text in docs.items():
        w = (text or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute(w)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
        want[i] = (i, len(runs), s, length, q, runs and 1000 * length // q or None, sha(lines), sha(b" ".join(brute_kept(w, runs))))
    got = queries.op12_periodic_runs(spark, str(DATA)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert {r.doc_id: tuple(r) for r in got} == want
    assert sum(w[1] > 0 for w in want.values()) > 10
