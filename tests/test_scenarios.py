"""Whole assessments of small cases against hand-written expectations."""

import copy
import re

import pytest

from attestra.operators import chain, findings

from . import support


def assess(spark, rows, files, **options):
    c = support.case(spark, rows, files, **options)
    found = chain.all_findings(c, chain.evaluate(c))
    return {r.key: r for r in findings.keyed(found).collect()}, findings.status(found).first().status


def changed(**edits):
    rows, files = support.clean()
    rows = copy.deepcopy(rows)
    for name, edit in edits.items():
        edit(rows[name] if name in rows else files)
    return rows, files


def odd_ones(found):
    return {k: (r.outcome, r.reason) for k, r in found.items() if r.outcome != "PASS"}


def down(o, *checks):
    return {f"{c}:obligation:{o}": ("NOT_EVALUATED", "BLOCKED_BY_UPSTREAM") for c in checks}


def drop(**match):
    def edit(rows):
        rows[:] = [r for r in rows if any(r.get(k) != v for k, v in match.items())]

    return edit


def put(where, **new):
    def edit(rows):
        for r in rows:
            if all(r.get(k) == v for k, v in where.items()):
                r.update(new)

    return edit


def add(*more, like=None, **new):
    def edit(rows):
        rows.extend([*more] or [{**rows[like], **new}])

    return edit


def without(path):
    return lambda files: files.pop(path)


def to(path, value):
    return lambda files: files.update({path: value})


SCENARIOS = {
    "clean": ({}, {}, "READY_FOR_REVIEW", {}),
    "no records": ({"inspections": drop(inspection_id="I-1"), "artifacts": drop(inspection_id="I-1"), "approvals": drop(inspection_id="I-1")}, {}, "BLOCKED",
                   {"R2:obligation:O-1": ("FAIL", "NO_CURRENT_INSPECTION"), **down("O-1", "R3", "R4", "R5", "R6")}),
    "absence proves nothing": ({"inspections": drop(inspection_id="I-1"), "artifacts": drop(inspection_id="I-1"), "approvals": drop(inspection_id="I-1")}, {"coverage": {"inspections": "partial", "artifacts": "complete_for_declared_scope", "approvals": "complete_for_declared_scope", "evidence_files": "complete_for_declared_scope"}}, "UNKNOWN",
                               {"R1:dataset:inspections": ("UNKNOWN", "COVERAGE_PARTIAL"), "R2:obligation:O-1": ("UNKNOWN", "ABSENCE_UNCONFIRMED"), **down("O-1", "R3", "R4", "R5", "R6"), **{f"R2:obligation:O-{k}": ("UNKNOWN", "CARDINALITY_UNCONFIRMED") for k in (2, 3, 4)}}),
    "wrong project": ({"artifacts": put({"artifact_id": "F-2-photo"}, project_id="X")}, {}, "BLOCKED", {"R3:obligation:O-2": ("FAIL", "ARTIFACT_PROJECT_MISMATCH"), **down("O-2", "R4", "R5", "R6")}),
    "file changed": ({"files": to("files/3/photo.bin", "0" * 64)}, {}, "BLOCKED", {"R6:obligation:O-3": ("FAIL", "EVIDENCE_CHANGED_SINCE_APPROVAL")}),
    "file gone": ({"files": without("files/3/photo.bin")}, {}, "BLOCKED", {"R5:obligation:O-3": ("FAIL", "FILE_ABSENT"), **down("O-3", "R6")}),
    "file unreadable": ({"files": to("files/3/photo.bin", "unreadable")}, {}, "UNKNOWN", {"R5:obligation:O-3": ("UNKNOWN", "FILE_UNREADABLE"), **down("O-3", "R6")}),
    "kind missing": ({"artifacts": drop(artifact_id="F-4-report")}, {}, "BLOCKED", {"R4:obligation:O-4": ("FAIL", "KIND_MISSING"), **down("O-4", "R6")}),
    "two current": ({"inspections": add(like=0, inspection_id="I-9")}, {}, "BLOCKED", {"R2:obligation:O-1": ("FAIL", "MULTIPLE_CURRENT"), **down("O-1", "R3", "R4", "R5", "R6")}),
    "two current revisions": ({"artifacts": add(like=0, revision="2")}, {}, "BLOCKED", {"R0:artifact:F-1-photo#MULTIPLE_CURRENT_REVISIONS": ("FAIL", "MULTIPLE_CURRENT_REVISIONS"), **down("O-1", "R2", "R3", "R4", "R5", "R6")}),
    "exact duplicate": ({"approvals": add(like=1)}, {}, "BLOCKED", {"R0:approval:Q-2#DUPLICATE_KEY": ("FAIL", "DUPLICATE_KEY"), **down("O-2", "R2", "R3", "R4", "R5", "R6")}),
    "bad path": ({"artifacts": put({"artifact_id": "F-2-photo"}, relative_path="a/../b")}, {}, "UNKNOWN", {"R0:artifact:F-2-photo@1#INVALID_PATH": ("UNKNOWN", "INVALID_PATH"), **down("O-2", "R2", "R3", "R4", "R5", "R6")}),
    "later revocation": ({"approvals": add(like=0, approval_id="Q-9", decision="revoked", decided_at="2024-01-03T00:00:00Z")}, {}, "BLOCKED", {"R6:obligation:O-1": ("FAIL", "APPROVAL_REVOKED")}),
    "conflict at one time": ({"approvals": add(like=0, approval_id="Q-9", decision="rejected")}, {}, "UNKNOWN", {"R6:obligation:O-1": ("UNKNOWN", "CONFLICTING_DECISIONS")}),
    "doubtful later": ({"approvals": add(like=0, approval_id="Q-9", evidence_digest=None, decided_at="2024-01-03T00:00:00Z")}, {}, "UNKNOWN", {"R6:obligation:O-1": ("UNKNOWN", "BINDING_UNAVAILABLE")}),
    "doubtful earlier": ({"approvals": add(like=0, approval_id="Q-9", evidence_digest=None, decided_at="2024-01-01T00:00:00Z")}, {}, "READY_FOR_REVIEW", {}),
    "other revision": ({"approvals": put({"approval_id": "Q-1"}, inspection_revision="0")}, {}, "BLOCKED", {"R6:obligation:O-1": ("FAIL", "REVISION_NOT_APPROVED")}),
    "not approved": ({"approvals": drop(approval_id="Q-1")}, {}, "BLOCKED", {"R6:obligation:O-1": ("FAIL", "NO_APPROVAL")}),
    "out of scope": ({"inspections": add(like=0, inspection_id="I-9", obligation_id=None)}, {}, "READY_FOR_REVIEW", {"R7:inspection:I-9": ("FAIL", "UNMATCHED_INSPECTION")}),
    "not completed": ({"inspections": put({"inspection_id": "I-1"}, completion_status="in_progress")}, {}, "BLOCKED", {"R2:obligation:O-1": ("FAIL", "NOT_COMPLETED"), **down("O-1", "R3", "R4", "R5", "R6")}),
    "no timestamp": ({"inspections": put({"inspection_id": "I-1"}, completed_at=None)}, {}, "BLOCKED", {"R0:inspection:I-1@1#COMPLETED_WITHOUT_TIMESTAMP": ("FAIL", "COMPLETED_WITHOUT_TIMESTAMP"), **down("O-1", "R2", "R3", "R4", "R5", "R6")}),
    "from the future": ({"approvals": put({"approval_id": "Q-1"}, decided_at="2025-01-01T00:00:00Z")}, {}, "UNKNOWN", {"R0:approval:Q-1#TIMESTAMP_AFTER_AS_OF": ("UNKNOWN", "TIMESTAMP_AFTER_AS_OF"), **down("O-1", "R2", "R3", "R4", "R5", "R6")}),
    "no requirement": ({"scope": put({"obligation_id": "O-1"}, activity_kind="other"), "inspections": put({"inspection_id": "I-1"}, activity_kind="other")}, {}, "UNKNOWN", {"R4:obligation:O-1": ("UNKNOWN", "REQUIREMENT_UNDEFINED"), **down("O-1", "R5", "R6")}),
    "scope not accepted": ({}, {"scope_accepted": False}, "UNKNOWN", {"R1:project:P": ("UNKNOWN", "SCOPE_NOT_ACCEPTED"), "R7:snapshot:all": ("NOT_EVALUATED", "BLOCKED_BY_UPSTREAM"), **{k: v for o in range(1, 5) for k, v in down(f"O-{o}", "R2", "R3", "R4", "R5", "R6").items()}}),
}


ALONE = [name for name, (_, options, _, _) in SCENARIOS.items() if options]


@pytest.mark.parametrize("name", ALONE)
def test_scenario(spark, name):
    edits, options, status, want = SCENARIOS[name]
    found, got = assess(spark, *changed(**edits), **options)
    assert odd_ones(found) == want
    assert got == status
    r0 = sum(k.startswith("R0") for k in found)
    r7 = sum(k.startswith("R7") for k in found)
    assert len(found) == max(1, r0) + 5 + 5 * 4 + max(1, r7)


def test_scenarios_side_by_side(spark):
    """All scenarios that share their settings as one case; each stays within its own obligations."""
    rows, files, want, states = {}, {}, {}, {}
    for k, name in enumerate(n for n in SCENARIOS if n not in ALONE):
        edits, _, status, odd = SCENARIOS[name]
        tag = f"s{k:02d}."
        more_rows, more_files = support.tagged(*changed(**edits), tag)
        for d, rs in more_rows.items():
            rows.setdefault(d, []).extend(rs)
        files |= more_files
        want |= {re.sub(r":([OIFQ]-)", rf":{tag}\1", key): v for key, v in odd.items()}
        states[tag] = status
    found, status = assess(spark, rows, files)
    assert odd_ones(found) == want and status == "BLOCKED"
    for tag, state in states.items():
        mine = [r.outcome for k, r in found.items() if tag in k and r.required]
        assert ("BLOCKED" if "FAIL" in mine else "UNKNOWN" if {"UNKNOWN", "NOT_EVALUATED"} & set(mine) else "READY_FOR_REVIEW") == state
    assert sum(k.startswith("R2") for k in found) == 4 * len(states)


def test_dangling_reference_contradicts_coverage(spark):
    rows, files = changed(approvals=add(like=0, approval_id="Q-9", inspection_id="I-404"))
    found, status = assess(spark, rows, files)
    assert odd_ones(found)["R0:approval:Q-9#DANGLING_REFERENCE"] == ("UNKNOWN", "DANGLING_REFERENCE")
    assert found["R0:approval:Q-9#DANGLING_REFERENCE"].observed == '{"count":1,"missing":[{"field":"inspection_id","target":"inspections","target_key":"I-404"}]}'
    assert found["R0:approval:Q-9#DANGLING_REFERENCE"].required is False
    assert odd_ones(found)["R1:dataset:inspections"] == ("UNKNOWN", "COVERAGE_CONTRADICTED")
    assert status == "UNKNOWN"


def test_malformed_row_is_unattributable(spark):
    rows, files = changed(inspections=add({"cells": ["I-5", "1"]}))
    found, _ = assess(spark, rows, files)
    key = next(k for k in found if k.startswith("R0:unattributable_row:inspections."))
    assert found[key].reason == "MALFORMED_ROW" and found[key].required
    assert odd_ones(found)["R1:dataset:inspections"] == ("UNKNOWN", "UNATTRIBUTABLE_RECORDS")


def test_revision_binding(spark):
    rows, files = changed(approvals=put({}, evidence_digest=None))
    rows["approval_items"] = [dict(approval_id=f"Q-{k}", artifact_id=f"F-{k}-{d}", artifact_revision="1" if k < 4 else "0") for k in range(1, 5) for d in ("photo", "report") if (k, d) != (3, "photo")]
    found, _ = assess(spark, rows, files, binding="revisions")
    assert odd_ones(found) == {
        "R0:approval_item:Q-4/F-4-photo#DANGLING_REFERENCE": ("UNKNOWN", "DANGLING_REFERENCE"), "R0:approval_item:Q-4/F-4-report#DANGLING_REFERENCE": ("UNKNOWN", "DANGLING_REFERENCE"),
        "R1:dataset:artifacts": ("UNKNOWN", "COVERAGE_CONTRADICTED"), **down("O-4", "R2", "R3", "R4", "R5", "R6"),
        **{f"R3:obligation:O-{k}": ("UNKNOWN", "IDENTITY_UNCONFIRMED") for k in (1, 2, 3)}, **{f"R5:obligation:O-{k}": ("UNKNOWN", "AVAILABILITY_UNCONFIRMED") for k in (1, 2, 3)}, **{k: v for o in (1, 2, 3) for k, v in down(f"O-{o}", "R6").items()},
    }
    for item in rows["approval_items"]:
        item["artifact_revision"] = "1"
    found, _ = assess(spark, rows, files, binding="revisions")
    assert odd_ones(found) == {"R6:obligation:O-3": ("FAIL", "EVIDENCE_CHANGED_SINCE_APPROVAL")}
    found, _ = assess(spark, rows, files)
    assert odd_ones(found) == {f"R6:obligation:O-{k}": ("UNKNOWN", "BINDING_STRENGTH_INSUFFICIENT") for k in range(1, 5)}


def test_row_order_changes_nothing(spark):
    rows, files = changed(artifacts=put({"artifact_id": "F-2-photo"}, project_id="X"), approvals=add(like=1))
    a, _ = assess(spark, rows, files)
    for r in rows.values():
        r.reverse()
    b, _ = assess(spark, rows, files)
    assert {k: r.asDict() for k, r in a.items()} == {k: r.asDict() for k, r in b.items()}


def test_unmapped_labels_are_never_accepted(spark):
    rows, files = changed(inspections=put({"inspection_id": "I-1"}, x_source="table=t;rid=1"))
    listed = spark.createDataFrame([("inspections", "table=t;rid=1", "completion_status")], "dataset string, source string, field string")
    found, _ = assess(spark, rows, files, unmapped=listed)
    assert odd_ones(found) == {"R0:inspection:I-1@1#UNMAPPED_VALUE": ("UNKNOWN", "UNMAPPED_VALUE"), **down("O-1", "R2", "R3", "R4", "R5", "R6")}


def test_without_duplicate_detection_a_duplicate_is_missed(spark):
    c = support.case(spark, *changed(approvals=add(like=1)))
    found = chain.all_findings(c, chain.evaluate(c, detect_duplicates=False))
    assert not found.where("reason = 'DUPLICATE_KEY'").count()
