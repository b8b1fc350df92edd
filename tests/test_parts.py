"""What a query asks of an assessment is made, and no more."""

from attestra.operators import chain, integrity

from . import support


def test_parts_are_made_when_they_are_asked_for(spark):
    rows, files = support.clean()
    rows["inspections"][1]["completed_at"] = None
    rows["inspections"].append(dict(rows["inspections"][0], inspection_id="I-x", obligation_id="O-none"))
    case = support.case(spark, rows, files)
    done = chain.evaluate(case)
    codes = ("COMPLETED_WITHOUT_TIMESTAMP",)
    found = integrity.findings(done.defects_of(*codes), done.records, codes).collect()
    assert [(r.subject_id, r.reason, r.required) for r in found] == [("I-2@1", codes[0], True)]
    assert set(done.records.rows.made) == {"inspections", "scope"}
    listed = {(r.check_id, r.subject_id, r.outcome) for r in done.findings_of("R1", "R7").collect()}
    assert listed == {("R1", n, "PASS") for n in ("P", "inspections", "artifacts", "approvals", "evidence_files")} | {("R7", "I-x", "FAIL")}
    assert not {"defects", "r2", "chain", "findings"} & set(done.__dict__)
    assert done.evidence.where("digest IS NOT NULL").count() == 3 and "chain" not in done.__dict__
    whole = chain.evaluate(case)
    assert {(r.check_id, r.subject_id, r.outcome) for r in whole.findings.where("check_id IN ('R1', 'R7')").collect()} == listed
    names = ("check_id", "subject_id", "code_suffix", "outcome", "reason", "required", "blocked_by", "caused_by")
    assert sorted(map(repr, done.outcomes.select(*names).collect())) == sorted(map(repr, whole.findings.select(*names).collect()))
