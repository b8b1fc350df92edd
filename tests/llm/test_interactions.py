"""Every order of the filters against a recount from the documents themselves."""

import re
from collections import Counter
from itertools import permutations

import pytest

from attestra.llm import interactions

from . import cases

LABELS = "doc_id long, quality int, toxic int"
GOOD = " ".join(f"word{chr(97 + k % 26)}{k}" for k in range(60))


def brute(rows, labels):
    """(part, order, step) -> counts and the filter's removals over all orders."""
    quality, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    fails = []
    for i, text, part in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        out = {"A"} if len(words) < 50 else set()
        out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        out |= {"D"} if set(text) & set("#$%&*|") else set()
        out |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else set()
        fails.append((part or "", i, out))
    want, total = {}, Counter()
    for part in {p for p, _, _ in fails}:
        mine = [(i, f) for p, i, f in fails if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in mine)
                total[part, f] += len(gone)
                want[part, "".join(order), k + 1] = [len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in mine), sum(i in quality for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in want.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = interactions.audit(interactions.cells(docs, spark.createDataFrame(labels, LABELS))).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*interactions.COUNTS, "shapley")) for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize("n", range(1, 7))
def test_the_walk_visits_all_orders_by_single_swaps(n):
    order = list(range(n))
    seen = {tuple(order)}
    for k in interactions.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(permutations(range(n)))


def test_against_a_recount(spark):
    texts = [GOOD, GOOD + " #", GOOD.upper(), "one two", None, "", "a a b " * 30, GOOD + " SHOUTING LOUD & CLEAR ABOUT ALL OF IT NOW", "ünï " * 70, "x\x1cy z \x0b" * 60]
    rows = [(k, texts[k * 7 % len(texts)], ["a", "b", None, ""][k % 4]) for k in range(60)]
    rows += [(3, texts[0], "a"), (3, texts[0], "b"), (None, texts[0], "a"), (None, texts[0], "a"), (-5, texts[3], "c")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 50)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (999, 1, 1)]
    labels = [(i, q if q is None else int(q), t if t is None else int(t)) for i, q, t in labels]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_copies_are_found_across_parts_and_after_removal(spark):
    rows = [(k, GOOD, f"s{k % 3}") for k in range(30)] + [(100, "short", "s0"), (101, "short", "s1")]
    got = audited(spark, rows, [])
    assert got["s0", "ABCDE", 5][1] == 9  # all copies but the first
    assert got["s1", "AEBCD", 2][2] == 1  # the short copy was removed by A
    assert got == brute(rows, [])


def test_odd_rows_empty_tables_and_clashing_names(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    out = interactions.audit(interactions.cells(cases.odd(spark), labels, part_col="lang")).collect()
    assert len(out) == 3 * 600
    assert interactions.audit(interactions.cells(cases.empty(spark), labels, part_col="lang")).count() == 0
    clash = cases.clashing(spark).selectExpr("*", "'s' AS part", "1L AS id", "2L AS mask", "true AS first", "true AS is_good")
    rows = interactions.audit(interactions.cells(clash, labels, part_col="part")).collect()
    assert {r.part for r in rows} == {"s"} and len(rows) == 600
