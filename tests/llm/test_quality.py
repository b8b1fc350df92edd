import random

from attestra.llm import quality

from . import cases


def brute(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) for k in range(3) if windows.count(w) > 1} if len(windows) < 500 else None
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), None if repeated is None else len(repeated)


def test_measures(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["a", "b", "cc", "#d", "é|", "x\ny", " ", "!"]) for _ in range(rng.randint(0, 60))), "en", 0.0) for k in range(200)]
    docs = spark.createDataFrame(rows + cases.ODD, cases.TEXT)
    want = sorted(brute(t) for _, t, _, _ in rows + cases.ODD if t is None or len(t) < 9000)
    got = [tuple(r[m] for m in quality.MEASURES) for r in quality.judge(docs, quality.RULES).collect()]
    assert sorted(g for g in got if g[0] < 9000) == want
    long = next(g for g in got if g[0] >= 9000)
    assert long[4] == long[0]  # the same sentence all over


def test_order_changes_no_verdict(spark):
    docs = spark.createDataFrame([(k, t, "en", 0.0) for k, t in enumerate(["w " * 60, "A B C! " * 40, "one two", " ".join(f"word{i}" for i in range(80)), "# " * 70])], cases.TEXT)
    orders = [quality.RULES, quality.RULES[::-1], quality.planned(docs, fraction=1.0)]
    verdicts = [sorted((r.doc_id, r.kept) for r in quality.judge(docs, o).collect()) for o in orders]
    assert verdicts[0] == verdicts[1] == verdicts[2] and dict(verdicts[0])[3] is True
    assert quality.keep(docs).columns == docs.columns
    assert sorted(r.doc_id for r in quality.keep(docs).collect()) == [k for k, kept in verdicts[0] if kept]


def test_best_rejection_per_cost_runs_first():
    costs = {"few_words": (100, 1, 1.0), "symbols": (100, 50, 0.1), "capitals": (100, 50, 1.0)}
    names = [r.name for r in quality.order_of(quality.RULES, costs)]
    assert names[:3] == ["symbols", "capitals", "few_words"] and len(names) == len(quality.RULES)


def test_empty_and_clashing(spark):
    assert quality.keep(cases.empty(spark)).count() == 0
    assert quality.judge(cases.clashing(spark), quality.RULES).count() == 1
    assert quality.keep(cases.clashing(spark)).columns == cases.clashing(spark).columns
