"""The relational model: datasets, their columns, keys and links. Fixed values."""

from __future__ import annotations

from typing import NamedTuple


class Field(NamedTuple):
    name: str
    kind: str  # id rev kind bool ts digest text path, or the values of a closed list joined by |
    required: bool


class Dataset(NamedTuple):
    subject: str  # what a row of it is called in findings
    fields: tuple[Field, ...]
    key: tuple[str, ...]
    link: str | None  # the column that leads to the parent
    between: str  # what stands between the parts of a key
    covered_by: str | None  # whose coverage declaration covers it


def _dataset(subject: str, columns: str, key: str, link: str | None, between: str = "", covered_by: str | None = None) -> Dataset:
    """``columns``: name:kind, with ! for required."""
    fields = [c.split(":") for c in columns.split()]
    return Dataset(subject, tuple(Field(n, k.rstrip("!"), k.endswith("!")) for n, k in fields), tuple(key.split()), link, between, covered_by)


COMPLETION = "completed|in_progress|not_started|cancelled"
DECISION = "approved|rejected|revoked"

DATASETS: dict[str, Dataset] = {
    "scope": _dataset("scope_row", "obligation_id:id! project_id:id! scope_revision:rev! asset_id:id! activity_kind:kind!", "obligation_id", None),
    "inspections": _dataset(
        "inspection",
        "inspection_id:id! revision:rev! is_current:bool! obligation_id:id project_id:id! asset_id:id! activity_kind:kind! "
        f"completion_status:{COMPLETION}! completed_at:ts",
        "inspection_id revision", "obligation_id", "@", "inspections",
    ),
    "artifacts": _dataset(
        "artifact",
        "artifact_id:id! revision:rev! is_current:bool! inspection_id:id! project_id:id! asset_id:id! document_kind:kind! relative_path:path",
        "artifact_id revision", "inspection_id", "@", "artifacts",
    ),
    "approvals": _dataset(
        "approval",
        f"approval_id:id! inspection_id:id! inspection_revision:rev! evidence_digest:digest decision:{DECISION}! decided_at:ts! decided_by:text!",
        "approval_id", "inspection_id", "", "approvals",
    ),
    "approval_items": _dataset(
        "approval_item", "approval_id:id! artifact_id:id! artifact_revision:rev!", "approval_id artifact_id", "approval_id", "/", "approvals"
    ),
}

COVERED = ("inspections", "artifacts", "approvals", "evidence_files")
COMPLETE = "complete_for_declared_scope"
#: Reasons for less than complete coverage, the first that applies decides; and what it makes of the coverage.
COVERAGE_REASONS = {
    "DATASET_MISSING": "unverified",
    "COVERAGE_PARTIAL": "partial",
    "COVERAGE_UNVERIFIED": "unverified",
    "COVERAGE_BASIS_NOT_ACCEPTED": "unverified",
    "CHANGED_DURING_CAPTURE": "unverified",
    "COVERAGE_CONTRADICTED": "partial",
    "UNATTRIBUTABLE_RECORDS": "partial",
}
#: The order in which subjects of findings are listed.
SUBJECTS = ("snapshot", "project", "dataset", "obligation", "scope_row", "inspection", "artifact", "approval", "approval_item", "unattributable_row")
CHECKS = ("R0", "R1", "R2", "R3", "R4", "R5", "R6", "R7")
OUTCOMES = ("PASS", "FAIL", "UNKNOWN", "NOT_EVALUATED")
