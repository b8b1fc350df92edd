import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from attestra.llm import packing

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizers_library():
    rng = random.Random(2)
    parts = ["a", "bc", " ", "  ", "\n", "\t", "1", "'s", "\x1c", "\xa0", "é", "　", ".", "x y", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)] + ["a <|endoftext|> b"]
    library, own = Tokenizer.from_file(PATH), packing.ByteBpe(PATH)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.encode(t) for t in texts] == want


def test_long_runs_of_space():
    library, own = Tokenizer.from_file(PATH), packing.ByteBpe(PATH)
    for text in (" " * 10**6, "\n" * 10**6, "a  b" + " " * 10**6 + "c d", "x" + " \n\t\r" * 250_000 + "y  z", " " * 999 + "a" + " " * 1001):
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_equal_rows_without_ids_spread(spark):
    made = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "1L AS length", "7L AS ids_crc32", "id AS number")
    rows = packing.placed(made, 16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 2000


def test_plan_fills_without_gaps():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([8, 64, 1024])
        histogram = {rng.randint(1, capacity): rng.randint(1, rng.choice([3, 50, 3000])) for _ in range(rng.randint(0, 40))}
        steps, n = packing.plan(histogram, capacity)
        placed, counts = defaultdict(list), Counter()
        for s in steps:
            counts[s.length] += s.hi - s.lo
            for r in range(s.hi - s.lo):
                placed[s.first + r // s.each].append((s.at + r % s.each * s.length, s.length))
        assert counts == Counter(histogram) and sorted(placed) == list(range(n))
        for slots in placed.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(steps) <= 6 * len(histogram) + 6


def test_plan_is_best_fit_decreasing():
    histogram = {7: 3, 5: 4, 3: 6, 2: 5, 1: 2}
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [k for k, b in enumerate(bins) if b >= length]
            k = min(fits, key=lambda k: bins[k]) if fits else len(bins)
            if not fits:
                bins.append(10)
            bins[k] -= length
    assert packing.plan(histogram, 10)[1] == len(bins)


def test_pieces_and_places(spark):
    docs = cases.odd(spark)
    rows = packing.pack(docs, PATH, capacity=64).collect()
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text, _, _ in cases.ODD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 64 + 1
        for k, s in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[s : s + 64] if k else ids[:first]
            want[i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 64) + 1


def test_hot_length_is_salted_and_ranked_once(spark):
    made = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, 5L, 1 + id % 7) AS length", "7L AS ids_crc32", "id AS number")
    rows = packing.placed(made, 16).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000


def test_empty_and_clashing(spark):
    assert packing.pack(cases.empty(spark), PATH).count() == 0
    assert packing.pack(cases.clashing(spark), PATH).count() == 1
