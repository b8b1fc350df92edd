"""Planted lexicons, disguises, exceptions, and held-out accuracy."""

import os
import random
from pathlib import Path

import pytest

from attestra.llm import queries, toxicity

from . import cases

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01"))
LABELS = "doc_id long, toxic int"
SYLLABLES = ["ra", "to", "ne", "mi", "shu", "pel", "gor", "wan", "dif", "ka", "bo", "ster"]


def prose(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def planted(n=900):
    """A third of the texts hold insults: two words, and a stem with many endings; clean ones hold one of the words in a phrase."""
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        words, toxic = prose(rng, rng.randint(20, 200)), k % 3 == 0
        for _ in range(max(2, len(words) // 30) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["zorgle", "fleebish", "quaxl" + rng.choice(SYLLABLES) + rng.choice(SYLLABLES)])
        if not toxic and k % 4 == 0:
            words[5:7] = ["zorgle", "garden"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = planted()
    return toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS))


def scored(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in toxicity.score(docs, model).collect()}


def test_folding():
    assert toxicity.fold("Pаth3tic Ｌ0ser МОRОN cl0wn id1ot $cum") == "pathetic ioser moron ciown idiot scum"
    assert toxicity.fold("in 2024 or 7 x") == "in 2024 or 7 x"
    for text in ("İstanbul ﬁne ß ǆ é́ 😀 3a", "İ" * 5 + "a1", "x" * 9 + "퟿"):
        assert len(toxicity.fold(text)) == len(text)


def test_what_is_learned(model):
    assert "zorgie " in model.weights and "fieebish " in model.weights
    assert any(t.startswith("quax") and not t.endswith(" ") for t in model.weights)  # a stem
    assert all(t.startswith(("zorg", "fiee", "quax")) for t in model.weights)
    assert "zorgie garden" in model.exceptions


def test_scores(spark, model):
    rng = random.Random(9)
    plain = prose(rng, 80)
    texts = [
        " ".join(plain),
        " ".join(plain[:40] + ["zorgle", "and", "quaxlmimi"] + plain[40:]),
        " ".join(plain[:40] + ["Z0RGLЕ,", "and", "quахlmimi!"] + plain[40:]),  # zero, Cyrillic
        " ".join(plain[:40] + ["zorgle", "garden"] + plain[40:]),
        None,
        " ".join(prose(rng, 5000) + ["fleebish"]),  # one in a long text
    ]
    out = scored(spark, model, texts)
    assert out[1].score > 0.7 and out[2].score == out[1].score
    assert out[0].score < 0.3 and out[3].score == pytest.approx(out[0].score, abs=0.02) and not out[3].hits
    assert out[4].score < 0.3 and out[4].n_words == 0
    assert out[5].score < out[1].score and len(out[5].hits) == 1
    assert [texts[2][h.start : h.end] for h in out[2].hits] == ["Z0RGLЕ", "quахlmimi"]


def test_copies_teach_once(spark):
    rows, labels = planted(300)
    rng = random.Random(1)
    text = " ".join(["zorgle", *prose(rng, 100), "uniqueword", "zorgle"])
    rows += [(10_000 + k, text + f" end{k}") for k in range(200)]
    labels += [(10_000 + k, 1) for k in range(200)]
    found = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS))
    assert "zorgie " in found.weights and not any(t.startswith("uniq") for t in found.weights)


@pytest.mark.parametrize("labels, share", [([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (2, None), (None, 1)], 0.0)])
def test_labels_of_one_kind(spark, labels, share):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id long, text string")
    found = toxicity.learn(docs, spark.createDataFrame(labels, LABELS))
    assert not found.weights
    assert all(r.score == pytest.approx(share, abs=1e-6) for r in toxicity.score(docs, found).collect())


def test_odd_rows_empty_tables_and_clashing_names(spark, model):
    assert toxicity.score(cases.odd(spark), model).count() == len(cases.ODD)
    assert toxicity.score(cases.empty(spark), model).count() == 0
    assert toxicity.score(cases.clashing(spark), model).count() == 1
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, 1), (8, 0), (None, 0)], LABELS)
    assert 0 <= toxicity.learn(cases.odd(spark), labels).logistic[0] ** 2
    toxicity.learn(cases.empty(spark), labels)
    toxicity.learn(cases.clashing(spark), labels)


@pytest.mark.skipif(not DATA.exists(), reason="the benchmark tables are not here")
def test_held_out_accuracy(spark):
    out = queries.op11_toxicity(spark, str(DATA)).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    toxic = [r for r in out if r.toxic == 1]
    flagged = [r for r in out if r.predicted == 1]
    assert sum(r.toxic for r in flagged) >= 0.9 * len(flagged)
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert all(0 <= r.score <= 1 for r in out)
