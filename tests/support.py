"""A clean case of four obligations, and ways to change it."""

import hashlib
import json

from attestra.functions.schema import DATASETS
from attestra.operators.case import Case, Declared, Pack
from attestra.operators.rules import EVIDENCE_SCHEME

BASIS = ("query_total_matched",)
KINDS = {"visual": ("photo", "report")}
ROWS = ("scope", "inspections", "artifacts", "approvals", "approval_items")


def digest(entries):
    """Restated from the definition: sorted entries in canonical JSON, hashed."""
    entries = sorted(entries, key=lambda e: (e["document_kind"], e["artifact_id"], e["revision"]))
    text = json.dumps({"artifacts": entries, "scheme": EVIDENCE_SCHEME}, sort_keys=True, separators=(",", ":"))
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def clean(n=4, tag=""):
    """Rows by dataset, and files: n obligations, each inspected, documented and approved; ids begin with the tag."""
    rows = {name: [] for name in ROWS}
    files = {}
    for k in range(1, n + 1):
        o, i = f"{tag}O-{k}", f"{tag}I-{k}"
        rows["scope"].append(dict(obligation_id=o, project_id="P", scope_revision="S1", asset_id=f"A-{k}", activity_kind="visual"))
        rows["inspections"].append(dict(inspection_id=i, revision="1", is_current="true", obligation_id=o, project_id="P", asset_id=f"A-{k}", activity_kind="visual", completion_status="completed", completed_at="2024-01-01T10:00:00Z"))
        entries = []
        for kind in ("photo", "report"):
            path = f"files/{tag}{k}/{kind}.bin"
            files[path] = hashlib.sha256(path.encode()).hexdigest()
            rows["artifacts"].append(dict(artifact_id=f"{tag}F-{k}-{kind}", revision="1", is_current="true", inspection_id=i, project_id="P", asset_id=f"A-{k}", document_kind=kind, relative_path=path))
            entries.append(dict(artifact_id=f"{tag}F-{k}-{kind}", document_kind=kind, revision="1", sha256=files[path]))
        rows["approvals"].append(dict(approval_id=f"{tag}Q-{k}", inspection_id=i, inspection_revision="1", evidence_digest=digest(entries), decision="approved", decided_at="2024-01-02T00:00:00Z", decided_by="Reviewer"))
    return rows, files


def case(spark, rows, files, binding="digest", coverage="complete_for_declared_scope", **changes):
    raw = {}
    for name, spec in DATASETS.items():
        columns = [f.name for f in spec.fields]
        schema = ", ".join(f"{c} string" for c in columns) + ", file string, row_number long, malformed boolean, raw_cells array<string>, x_source string"
        data = [(*(r.get(c) for c in columns), f"{name}.csv", k + 2, "cells" in r, r.get("cells"), r.get("x_source")) for k, r in enumerate(rows.get(name, []))]
        if name in rows:
            raw[name] = spark.createDataFrame(data, schema)
    listed = spark.createDataFrame([(p, "present" if len(s) == 64 else s, s if len(s) == 64 else None) for p, s in files.items()], "relative_path string, status string, sha256 string")
    claim = Declared(coverage, BASIS) if isinstance(coverage, str) else None
    declared = {d: (coverage.get(d) and Declared(coverage[d], BASIS)) if isinstance(coverage, dict) else claim for d in ("inspections", "artifacts", "approvals", "evidence_files")}
    settings = dict(raw=raw, files=listed, pack=Pack("P", "S1", KINDS, (BASIS,), binding), project_id="P", as_of="2024-06-01T00:00:00.000000Z", declared=declared, scope_revision="S1")
    return Case(**(settings | changes))


def tagged(rows, files, tag):
    """The same rows and files under ids of their own, so that many small cases make one."""
    old_rows, old_files = clean()
    new_rows, new_files = clean(tag=tag)
    rename = dict(zip(old_files, new_files, strict=True))
    rename |= {a["evidence_digest"]: b["evidence_digest"] for a, b in zip(old_rows["approvals"], new_rows["approvals"], strict=True)}

    def name(v):
        return rename.get(v) or (tag + v if isinstance(v, str) and v[:2] in ("O-", "I-", "F-", "Q-") else v)

    out = {d: [{k: name(v) for k, v in r.items()} for r in rs] for d, rs in rows.items()}
    return out, {rename[p]: new_files[rename[p]] if s == old_files[p] else s for p, s in files.items()}
