import random

from attestra.functions.schema import CHECKS, SUBJECTS
from attestra.operators import findings
from attestra.sources.staging import staged

from .test_shapes import shuffled


def test_every_finding_has_its_place(spark):
    rng = random.Random(3)
    rows = list({(rng.choice(CHECKS), rng.choice(SUBJECTS), f"s{rng.randint(0, 99):03}", rng.choice([None, "A", "B"])) for _ in range(2000)})
    df = spark.createDataFrame(rows, "check_id string, subject_kind string, subject_id string, code_suffix string")
    want = sorted(rows, key=lambda r: (CHECKS.index(r[0]), SUBJECTS.index(r[1]), r[2], r[3] or ""))
    keys = {tuple(r)[:4]: r.key for r in findings.keyed(df).collect()}
    placed = findings.numbered(df)
    assert {r.key: r.place for r in placed.collect()} == {keys[r]: k for k, r in enumerate(want, 1)}
    assert findings.numbered(df.limit(0)).count() == 0


def test_keys_of_two_findings_are_told_and_others_not_shuffled(spark):
    rows = staged(spark.range(0, 1_000_000, 1, 2).selectExpr("'R2' AS check_id", "'obligation' AS subject_kind", "'O-' || IF(id IN (7, 999999), 7, id) AS subject_id", "IF(id = 8, 'X', NULL) AS code_suffix"), "findings")
    before = shuffled(spark)
    assert [tuple(r) for r in findings.duplicate_findings(rows).collect()] == [("R2:obligation:O-7", 2)]
    assert shuffled(spark) - before < 5.5 * 1_000_000
