import random

import numpy as np
import xxhash

from attestra.llm import simhash

from . import cases


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    out = 0
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    for b in range(64):
        if 2 * sum(h >> b & 1 for h in hashes) > len(hashes):
            out |= 1 << b
    return out


def brute_components(fps):
    """fps: list of (id, fingerprint); id -> smallest id reachable."""
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_fingerprints(spark):
    got = simhash.with_fingerprints(cases.odd(spark)).collect()
    assert sorted((r.doc_id or 0, r.fp % 2**64) for r in got) == sorted((i or 0, brute_fingerprint(t)) for i, t, _, _ in cases.ODD)


def clouds(seed, centres, members, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(members):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, flips)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_links_connect_what_brute_force_connects(spark):
    for seed, centres, members, flips, chunk in ((1, 40, 6, 4, 2048), (2, 3, 90, 3, 2048), (3, 2, 150, 5, 40), (4, 400, 1, 0, 16)):
        fps = clouds(seed, centres, members, flips)
        table = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
        roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.links(table, chunk)).collect()}
        want = brute_components([(x, x) for x in fps])
        groups = lambda label: sorted(sorted(x for x in fps if label[x] == g) for g in set(label.values()))
        assert groups({x: roots.get(x, x) for x in fps}) == groups(want)


def test_bit_sliced_distances():
    rng = random.Random(5)
    fps = np.array(clouds(6, 5, 30, 6), np.uint64)
    planes = simhash.bit_planes(fps)
    query = np.array([rng.choice(fps) for _ in range(9)], np.uint64)
    near = simhash.within(planes[:, None, :], simhash.spread(query)[:, :, None])
    for q, words in zip(query, near, strict=True):
        got = {int(f) for k, f in enumerate(fps) if int(words[k // 64]) >> (k % 64) & 1}
        assert got == {int(f) for f in fps if (int(f) ^ int(q)).bit_count() <= 3}


def test_near_duplicates_on_odd_rows(spark):
    base = [(100 + k, cases.LONG[: 4000 + k], "en", 1.0) for k in range(4)]
    docs = spark.createDataFrame(cases.ODD + base, cases.TEXT)
    rows = [(i, brute_fingerprint(t)) for i, t, _, _ in cases.ODD + base if i is not None]
    want = brute_components(list(dict(rows).items()))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {i: got[i] for i in want} == want
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert sorted(set(ids)) == sorted({-1, *want.values()})
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert simhash.keep_one_of_each(cases.clashing(spark)).count() == 1
