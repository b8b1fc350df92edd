"""What is written of the records, and what a reader of them has to join."""

from attestra.operators import chain, integrity, rules
from attestra.sources import staging

from . import support


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_records_are_written_with_their_repeated_keys_and_raw_cells_of_quarantined_rows_alone(spark):
    rows, files = support.clean()
    rows["scope"] += [dict(rows["scope"][0]), dict(rows["scope"][1], asset_id="A-99"), dict(rows["scope"][2], obligation_id="O 3")]
    rec = chain.evaluate(support.case(spark, rows, files)).records
    assert not any("Join" in plan(df) for df in rec.rows.values())
    found = sorted(rec.rows["scope"].select("named", "kind", "copies", "identical", "quarantined", "raw.asset_id", "locator").collect(), key=lambda r: r.locator)
    assert [(r.named, r.copies, r.identical, r.asset_id) for r in found[:6]] == [
        ("O-1", 2, True, "A-1"), ("O-2", 2, False, "A-2"), ("O-3", None, None, None), ("O-4", None, None, None), ("O-1", 2, True, "A-1"), ("O-2", 2, False, "A-99")]
    assert found[6].named.startswith("scope.") and found[6].kind == "unattributable_row" and found[6].quarantined
    assert [r.locator for r in found] == [f"scope.csv#row={k}" for k in range(2, 9)]


def test_rows_with_missing_targets_are_told_by_the_values_that_lack(spark):
    rows, files = support.clean()
    rows["artifacts"][0]["inspection_id"] = "I-none"
    rows["approvals"][1]["inspection_id"] = "I-none"
    rows["approval_items"] = [dict(approval_id="Q-1", artifact_id="F-1-photo", artifact_revision=r) for r in ("1", "2")]
    rows["approval_items"][1]["approval_id"] = "Q-none"
    done = chain.evaluate(support.case(spark, rows, files))
    found = {(r.dataset, r.locator, r.detail) for r in done.defects.where("code = 'DANGLING_REFERENCE'").collect()}
    text = lambda field, target, key: f'{{"field":"{field}","target":"{target}","target_key":"{key}"}}'
    assert found == {
        ("artifacts", "artifacts.csv#row=2", text("inspection_id", "inspections", "I-none")), ("approvals", "approvals.csv#row=3", text("inspection_id", "inspections", "I-none")),
        ("approval_items", "approval_items.csv#row=3", text("approval_id", "approvals", "Q-none")), ("approval_items", "approval_items.csv#row=3", text("artifact_id", "artifacts", "F-1-photo@2")),
    }


def test_files_that_no_candidate_cites_are_not_joined(spark):
    held = staging.staged(spark.range(0, 300).selectExpr("CASE WHEN id % 3 = 0 THEN 'docs/' || id END AS path"), "test-held")
    files = spark.range(20_000).selectExpr("'docs/' || id AS path", "id")
    left = staging.narrowed(files, held, "path")
    assert left.columns == ["path", "id"]
    found = {r.id for r in left.collect()}
    assert set(range(0, 300, 3)) <= found and len(found) < 2_500
    none = staging.narrowed(files, held.where("path IS NULL"), "path")
    assert none.count() == 0


def test_references_into_one_dataset_are_looked_up_together(spark, monkeypatch):
    rows, files = support.clean()
    done = chain.evaluate(support.case(spark, rows, files))
    rec, written = done.records, []
    monkeypatch.setattr(integrity, "staged", lambda df, name: written.append(name) or df)
    assert len(integrity.dangling(done.case, rec)) == 4 and written.count("missing") == 3


def test_the_latest_match_needs_no_second_reading_of_approvals(spark):
    columns = "obligation_id string, approval_id string, inspection_revision string, evidence_digest string, decision string, decided_at string, mine string, class string"
    told = [("O", "a", "1", "d", "rejected", "2024-01-01", None, "MATCH"), ("O", "b", "1", "d", "approved", "2024-01-02", None, "MATCH"), ("N", "c", "1", "x", "approved", "2024-01-03", None, "MISMATCH")]
    found = rules.approval_verdicts(spark.createDataFrame(told, columns), True)
    assert "Join" not in plan(found)
    assert {(r.obligation_id, r.r6_reason, *r.r6_approvals) for r in found.collect()} == {("O", "APPROVAL_COVERS_CURRENT", "b"), ("N", "EVIDENCE_CHANGED_SINCE_APPROVAL", "c")}
