"""DuckDB SQL that derives the registered queries' rows independently, from the same shapes."""

from __future__ import annotations

from ..functions.schema import DATASETS
from ..operators.rules import EVIDENCE_SCHEME
from ..sources.shapes import AS_OF, PROJECT, REQUIREMENTS, prelude

GRAMMAR = {
    "id": "[A-Za-z0-9][A-Za-z0-9._:-]{0,127}",
    "rev": "[A-Za-z0-9][A-Za-z0-9._-]{0,31}",
    "kind": "[a-z][a-z0-9_]{0,63}",
    "digest": "sha256:[0-9a-f]{64}",
}
TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})"
RESERVED = "('CON','PRN','AUX','NUL'," + ",".join(f"'{n}{i}'" for n in ("COM", "LPT") for i in range(1, 10)) + ")"


def time(c: str) -> str:
    """Canonical UTC text of a strict timestamp, or NULL."""
    frac = f"rpad(regexp_extract({c}, ':[0-9]{{2}}\\.([0-9]+)', 1), 6, '0')"
    hours = f"CAST(regexp_extract({c}, '[+-]([0-9]{{2}}):[0-9]{{2}}$', 1) AS INTEGER)"
    minutes = f"CAST(regexp_extract({c}, '[+-][0-9]{{2}}:([0-9]{{2}})$', 1) AS INTEGER)"
    shift = f"CASE WHEN {c} LIKE '%Z' THEN 0 ELSE ({hours} * 60 + {minutes}) * CASE WHEN substr({c}, length({c}) - 5, 1) = '-' THEN -1 ELSE 1 END END"
    local = f"TRY_CAST(substr({c}, 1, 10) || ' ' || substr({c}, 12, 8) || '.' || {frac} AS TIMESTAMP)"
    utc = f"({local} - to_minutes({shift}))"
    fits = f"substr({c}, 12, 2) <= '23' AND substr({c}, 15, 2) <= '59' AND substr({c}, 18, 2) <= '59' AND substr({c}, 1, 4) >= '0001' AND ({c} LIKE '%Z' OR ({hours} <= 23 AND {minutes} <= 59))"
    return f"CASE WHEN regexp_full_match({c}, '{TIME}') THEN CASE WHEN {fits} THEN CASE WHEN year({utc}) BETWEEN 1 AND 9999 THEN strftime({utc}, '%Y-%m-%dT%H:%M:%S.%fZ') END END END"


def path(c: str) -> str:
    """The first rule that a path breaks, or NULL."""
    odd = f"""regexp_extract({c}, '[\\p{{Cc}}\\\\<>:"|?*]')"""
    base = "upper(rtrim(string_split(g, '.')[1], ' '))"
    segment = f"CASE WHEN g = '' THEN 'empty-segment' WHEN g IN ('.', '..') THEN 'dot-segment' WHEN right(g, 1) IN ('.', ' ') THEN 'trailing-dot-or-space' WHEN length(g) > 100 THEN 'segment-too-long' WHEN {base} IN {RESERVED} THEN 'reserved-name' END"
    first = f"list_filter(list_transform(string_split({c}, '/'), lambda g: {segment}), lambda r: r IS NOT NULL)[1]"
    return f"'path:' || CASE WHEN starts_with({c}, '/') THEN 'absolute' WHEN length({c}) > 240 THEN 'too-long' WHEN regexp_full_match({odd}, '\\p{{Cc}}') THEN 'control-character' WHEN {odd} <> '' THEN 'forbidden-character' ELSE {first} END"


def rule(kind: str, c: str, required: bool) -> str:
    if kind in GRAMMAR:
        broken = f"CASE WHEN NOT regexp_full_match({c}, '{GRAMMAR[kind]}') THEN 'grammar:{kind.upper()}' END"
    elif kind == "text":
        broken = f"CASE WHEN length({c}) NOT BETWEEN 1 AND 200 OR regexp_matches({c}, '\\p{{Cc}}') THEN 'grammar:TEXT' END"
    elif kind == "bool":
        broken = f"CASE WHEN {c} NOT IN ('true', 'false') THEN 'grammar:BOOL' END"
    elif kind == "ts":
        broken = f"CASE WHEN ({time(c)}) IS NULL THEN 'grammar:TS' END"
    elif kind == "path":
        broken = path(c)
    else:
        broken = f"CASE WHEN {c} NOT IN ({', '.join(repr(v) for v in kind.split('|'))}) THEN 'enum:{kind}' END"
    return f"CASE WHEN {c} IS NULL THEN {chr(39) + 'required' + chr(39) if required else 'NULL'} ELSE {broken} END"


def value(kind: str, c: str) -> str:
    return f"({c} = 'true')" if kind == "bool" else time(c) if kind == "ts" else c


def validated(name: str) -> str:
    """Common table expressions ``c_name`` (rules beside cells) and ``v_name`` (typed, with quarantine)."""
    spec = DATASETS[name]
    rules = ", ".join(f"{rule(f.kind, f.name, f.required)} AS r_{f.name}" for f in spec.fields)
    values = ", ".join(f"CASE WHEN r_{f.name} IS NULL THEN {value(f.kind, f.name)} END AS {f.name}" for f in spec.fields)
    keyed = " AND ".join(f"r_{k} IS NULL" for k in spec.key)
    subject = f" || '{spec.between}' || ".join(spec.key)
    link = f"r_{spec.link} IS NULL" if spec.link else "TRUE"
    bad = " + ".join(f"CAST(r_{f.name} IS NOT NULL AS INTEGER)" for f in spec.fields)
    raws = ", ".join(f"{f.name} AS raw_{f.name}" for f in spec.fields)
    same = ", ".join(f"raw_{f.name}" for f in spec.fields)
    return f"""c_{name} AS MATERIALIZED (SELECT *, {rules} FROM raw_{name}),
    t_{name} AS (SELECT {values}, {raws}, {", ".join(f"r_{f.name}" for f in spec.fields)}, {keyed} AS keyed, CASE WHEN {keyed} THEN {subject} END AS subject, {link} AS link_ok,
                 {bad} AS n_bad, file || '#row=' || CAST(row_number AS VARCHAR) AS locator FROM c_{name}),
    g_{name} AS (SELECT subject, count(*) AS copies, count(DISTINCT CAST(({same}) AS VARCHAR)) = 1 AS identical FROM t_{name} WHERE keyed GROUP BY subject HAVING count(*) > 1),
    v_{name} AS MATERIALIZED (SELECT t.*, g.copies, g.identical, t.n_bad > 0 OR g.copies IS NOT NULL AS quarantined FROM t_{name} t LEFT JOIN g_{name} g USING (subject))"""


KINDS = ", ".join(f"('{a}', '{d}')" for a, ds in REQUIREMENTS.items() for d in ds)
VALIDATED = ",\n".join(validated(n) for n in DATASETS)


def json_of(members: dict[str, str]) -> str:
    """JSON text of string members, null where the expression is null."""
    parts = [f"""'"{k}":' || coalesce('"' || {e} || '"', 'null')""" for k, e in sorted(members.items())]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def cells(name: str) -> str:
    members = json_of({f.name: f"raw_{f.name}" for f in DATASETS[name].fields})
    return f"""'{name}.' || substr(sha256('{{"cells":' || {members} || ',"dataset":"{name}"}}'), 1, 16)"""


def _defects() -> str:
    parts = []
    for name, spec in DATASETS.items():
        subject = f"coalesce(subject, {cells(name)})"
        kind = f"CASE WHEN keyed THEN '{spec.subject}' ELSE 'unattributable_row' END"
        head = f"'{name}' AS dataset, {kind} AS kind, {subject} AS subject"
        for f in spec.fields:
            code = f"CASE WHEN r_{f.name} LIKE 'path:%' THEN 'INVALID_PATH' ELSE 'INVALID_VALUE' END"
            detail = json_of({"field": f"'{f.name}'", "value": f"raw_{f.name}", "rule": f"r_{f.name}"})
            parts.append(f"SELECT {head}, {code} AS code, locator, {detail} AS detail, obligations, lost FROM a_{name} WHERE r_{f.name} IS NOT NULL")
        parts.append(f"SELECT {head}, 'DUPLICATE_KEY', locator, CAST(identical AS VARCHAR), obligations, lost FROM a_{name} WHERE copies IS NOT NULL")
    for name, key in (("inspections", "inspection_id"), ("artifacts", "artifact_id")):
        parts.append(
            f"SELECT '{name}', '{DATASETS[name].subject}', {key}, 'MULTIPLE_CURRENT_REVISIONS', locator, revision, obligations, lost FROM a_{name} "
            f"WHERE NOT quarantined AND is_current QUALIFY count(*) OVER (PARTITION BY {key}) > 1"
        )
    parts.append("SELECT 'inspections', 'inspection', subject, 'COMPLETED_WITHOUT_TIMESTAMP', locator, NULL, obligations, lost FROM a_inspections WHERE NOT quarantined AND is_current AND completion_status = 'completed' AND completed_at IS NULL")
    for name, column in (("inspections", "completed_at"), ("approvals", "decided_at")):
        detail = json_of({"field": f"'{column}'", "value": column})
        parts.append(f"SELECT '{name}', '{DATASETS[name].subject}', subject, 'TIMESTAMP_AFTER_AS_OF', locator, {detail}, obligations, lost FROM a_{name} WHERE NOT quarantined AND {column} > '{AS_OF}'")
    for name, column, target, shown, test in DANGLING:
        detail = json_of({"field": f"'{column}'", "target": f"'{target}'", "target_key": shown})
        parts.append(f"SELECT '{name}', '{DATASETS[name].subject}', subject, 'DANGLING_REFERENCE', locator, {detail}, obligations, lost FROM a_{name} r WHERE NOT quarantined AND NOT EXISTS ({test})")
    return "\nUNION ALL ".join(parts)


DANGLING = (
    ("artifacts", "inspection_id", "inspections", "inspection_id", "SELECT 1 FROM v_inspections x WHERE x.inspection_id = r.inspection_id"),
    ("approvals", "inspection_id", "inspections", "inspection_id", "SELECT 1 FROM v_inspections x WHERE x.inspection_id = r.inspection_id"),
    ("approval_items", "approval_id", "approvals", "approval_id", "SELECT 1 FROM v_approvals x WHERE x.keyed AND x.approval_id = r.approval_id"),
    ("approval_items", "artifact_id", "artifacts", "artifact_id || '@' || artifact_revision", "SELECT 1 FROM v_artifacts x WHERE x.keyed AND x.artifact_id = r.artifact_id AND x.revision = r.artifact_revision"),
)
NONE = "CAST([] AS VARCHAR[])"
ATTRIBUTED = f"""
    entity AS (SELECT inspection_id, list_sort(list_distinct(list(obligation_id))) AS obs FROM v_inspections WHERE inspection_id IS NOT NULL AND obligation_id IS NOT NULL GROUP BY inspection_id),
    a_scope AS (SELECT *, CASE WHEN keyed THEN [obligation_id] ELSE {NONE} END AS obligations, NOT keyed AS lost FROM v_scope),
    a_inspections AS (SELECT *, CASE WHEN keyed AND link_ok AND obligation_id IS NOT NULL THEN [obligation_id] ELSE {NONE} END AS obligations, NOT (keyed AND link_ok) AS lost FROM v_inspections),
    a_artifacts AS MATERIALIZED (SELECT v.*, CASE WHEN keyed AND link_ok THEN coalesce(obs, {NONE}) ELSE {NONE} END AS obligations, NOT (keyed AND link_ok) AS lost FROM v_artifacts v LEFT JOIN entity USING (inspection_id)),
    a_approvals AS MATERIALIZED (SELECT v.*, CASE WHEN keyed AND link_ok THEN coalesce(obs, {NONE}) ELSE {NONE} END AS obligations, NOT (keyed AND link_ok) AS lost FROM v_approvals v LEFT JOIN entity USING (inspection_id)),
    by_approval AS (SELECT approval_id, list_sort(list_distinct(flatten(list(coalesce(obs, {NONE}))))) AS obs, bool_or(NOT link_ok) AS lost_link
                    FROM v_approvals LEFT JOIN entity USING (inspection_id) WHERE keyed GROUP BY approval_id),
    a_approval_items AS MATERIALIZED (SELECT v.*, CASE WHEN keyed AND link_ok THEN coalesce(obs, {NONE}) ELSE {NONE} END AS obligations,
                         NOT (keyed AND link_ok) OR coalesce(lost_link, FALSE) AS lost FROM v_approval_items v LEFT JOIN by_approval USING (approval_id))"""
INTEGRITY = f"""{ATTRIBUTED},
    obligations AS MATERIALIZED (SELECT DISTINCT obligation_id FROM v_scope WHERE keyed),
    defects AS MATERIALIZED ({_defects()}),
    concerned AS MATERIALIZED (SELECT DISTINCT kind, subject, code, obligation_id FROM (SELECT kind, subject, code, unnest(obligations) AS obligation_id FROM defects) JOIN obligations USING (obligation_id)),
    merged AS MATERIALIZED (SELECT kind, subject, code, count(DISTINCT dataset || locator) AS n_rows, list_sort(list_distinct(list(detail))) AS details, bool_or(lost) AS lost FROM defects GROUP BY ALL),
    r0 AS MATERIALIZED (SELECT m.*, CASE WHEN code IN ('DUPLICATE_KEY', 'MULTIPLE_CURRENT_REVISIONS', 'COMPLETED_WITHOUT_TIMESTAMP') THEN 'FAIL' ELSE 'UNKNOWN' END AS outcome,
                  lost OR kind = 'scope_row' OR c.kind IS NOT NULL AS required
           FROM merged m LEFT JOIN (SELECT DISTINCT kind, subject, code FROM concerned) c USING (kind, subject, code)),
    blocking AS (SELECT obligation_id, list_sort(list('R0:' || kind || ':' || subject || '#' || code)) AS keys FROM concerned JOIN merged USING (kind, subject, code) WHERE NOT lost GROUP BY obligation_id),
    wrong AS ({" UNION ALL ".join(f"SELECT '{t}' AS dataset FROM v_{n} r WHERE NOT quarantined AND NOT EXISTS ({test})" for n, _, t, _, test in DANGLING)}),
    lost_rows AS ({" UNION ALL ".join(f"SELECT '{s.covered_by or n}' AS dataset FROM a_{n} WHERE quarantined AND lost" for n, s in DATASETS.items())}),
    coverage AS MATERIALIZED (
        SELECT dataset, list_filter([CASE WHEN dataset IN (SELECT dataset FROM wrong) THEN 'COVERAGE_CONTRADICTED' END, CASE WHEN dataset IN (SELECT dataset FROM lost_rows) THEN 'UNATTRIBUTABLE_RECORDS' END], lambda x: x IS NOT NULL) AS reasons
        FROM (VALUES ('inspections'), ('artifacts'), ('approvals'), ('evidence_files')) AS d(dataset)),
    complete AS MATERIALIZED (SELECT bool_or(dataset = 'inspections' AND len(reasons) = 0) AS i, bool_or(dataset = 'artifacts' AND len(reasons) = 0) AS a,
                 bool_or(dataset = 'approvals' AND len(reasons) = 0) AS p, bool_or(dataset = 'evidence_files' AND len(reasons) = 0) AS e FROM coverage)"""

LIVE = """
    li AS (SELECT * FROM v_inspections WHERE NOT quarantined), la AS (SELECT * FROM v_artifacts WHERE NOT quarantined),
    lp AS (SELECT * FROM v_approvals WHERE NOT quarantined), lit AS (SELECT * FROM v_approval_items WHERE NOT quarantined), ls AS (SELECT * FROM v_scope WHERE NOT quarantined)"""


def chain(binding: str = "digest") -> str:
    """CTE ``chain``: r2 to r6 of every obligation."""
    by_items = (
        "CASE WHEN has_items THEN 'BINDING_STRENGTH_INSUFFICIENT' END"
        if binding == "digest"
        else "CASE WHEN has_items THEN CASE WHEN coalesce(mine, []) = required_set THEN 'MATCH' ELSE 'MISMATCH' END END"
    )
    return f"""{INTEGRITY}, {LIVE}, kinds(activity_kind, document_kind) AS (VALUES {KINDS}),
    counted AS (SELECT s.obligation_id, s.project_id AS op, s.asset_id AS oa, s.activity_kind AS ok, count(*) FILTER (WHERE i.is_current) AS n_current,
                count(*) FILTER (WHERE i.is_current AND completion_status = 'completed') AS n_completed, count(*) FILTER (WHERE NOT i.is_current) AS n_superseded,
                max(i.inspection_id) FILTER (WHERE i.is_current) AS iid, max(i.revision) FILTER (WHERE i.is_current) AS irev, max(i.project_id) FILTER (WHERE i.is_current) AS ip,
                max(i.asset_id) FILTER (WHERE i.is_current) AS ia, max(i.activity_kind) FILTER (WHERE i.is_current) AS ik,
                list_sort(list(i.inspection_id || '@' || i.revision) FILTER (WHERE i.is_current)) AS cur
                FROM ls s LEFT JOIN li i ON i.obligation_id = s.obligation_id GROUP BY ALL),
    r2 AS MATERIALIZED (SELECT obligation_id, counted.* EXCLUDE (obligation_id), coalesce(keys, []) AS r2_blocked, CASE WHEN keys IS NOT NULL THEN 'BLOCKED_BY_UPSTREAM' WHEN n_current >= 2 THEN 'MULTIPLE_CURRENT'
             WHEN n_current = 1 AND n_completed = 0 THEN 'NOT_COMPLETED' WHEN n_current = 1 THEN CASE WHEN complete.i THEN 'SINGLE_CURRENT_COMPLETED' ELSE 'CARDINALITY_UNCONFIRMED' END
             WHEN complete.i THEN 'NO_CURRENT_INSPECTION' ELSE 'ABSENCE_UNCONFIRMED' END AS r2_reason
             FROM obligations LEFT JOIN counted USING (obligation_id) LEFT JOIN blocking USING (obligation_id), complete),
    cand AS MATERIALIZED (SELECT * FROM r2 WHERE r2_reason IN ('SINGLE_CURRENT_COMPLETED', 'CARDINALITY_UNCONFIRMED')),
    wrongs AS (SELECT obligation_id, 0 AS rank FROM cand WHERE ip <> op UNION ALL SELECT obligation_id, 1 FROM cand WHERE ia <> oa UNION ALL SELECT obligation_id, 2 FROM cand WHERE ik <> ok
               UNION ALL SELECT obligation_id, 3 FROM cand JOIN la ON la.inspection_id = iid AND la.is_current WHERE la.project_id <> op
               UNION ALL SELECT obligation_id, 4 FROM cand JOIN la ON la.inspection_id = iid AND la.is_current WHERE la.asset_id <> oa),
    r3 AS MATERIALIZED (SELECT obligation_id, CASE min(rank) WHEN 0 THEN 'INSPECTION_PROJECT_MISMATCH' WHEN 1 THEN 'INSPECTION_ASSET_MISMATCH' WHEN 2 THEN 'INSPECTION_ACTIVITY_MISMATCH' WHEN 3 THEN 'ARTIFACT_PROJECT_MISMATCH'
             WHEN 4 THEN 'ARTIFACT_ASSET_MISMATCH' ELSE CASE WHEN any_value(complete.a) THEN 'IDENTITY_CONSISTENT' ELSE 'IDENTITY_UNCONFIRMED' END END AS r3_reason, count(rank) AS n_mismatches
             FROM cand LEFT JOIN wrongs USING (obligation_id), complete GROUP BY obligation_id),
    sound AS (SELECT cand.* FROM cand JOIN r3 USING (obligation_id) WHERE r3_reason IN ('IDENTITY_CONSISTENT', 'IDENTITY_UNCONFIRMED')),
    held AS MATERIALIZED (SELECT obligation_id, artifact_id, la.revision, la.document_kind, la.relative_path, CASE WHEN la.relative_path IS NULL THEN 'no_path' ELSE coalesce(f.status, 'absent') END AS status, f.sha256
             FROM sound JOIN la ON la.inspection_id = iid AND la.is_current JOIN kinds k ON k.activity_kind = ik AND k.document_kind = la.document_kind LEFT JOIN files f ON f.relative_path = la.relative_path),
    r45 AS MATERIALIZED (SELECT sound.obligation_id, any_value(iid) AS iid, any_value(irev) AS irev, any_value(needed) AS needed, list_sort(list_filter(any_value(needed), lambda k: NOT list_contains(coalesce(list(document_kind) FILTER (WHERE artifact_id IS NOT NULL), []), k))) AS missing,
             count(artifact_id) AS n_files, count(*) FILTER (WHERE status IN ('absent', 'no_path')) AS n_away, count(*) FILTER (WHERE status = 'unreadable') AS n_unreadable, count(*) FILTER (WHERE status = 'too_large') AS n_large,
             'sha256:' || sha256('{{"artifacts":[' || string_agg('{{"artifact_id":"' || artifact_id || '","document_kind":"' || document_kind || '","revision":"' || revision || '","sha256":"' || sha256 || '"}}', ',' ORDER BY document_kind, artifact_id, revision) || '],"scheme":"{EVIDENCE_SCHEME}"}}') AS digest,
             list_sort(list_distinct(list(artifact_id || '@' || revision) FILTER (WHERE artifact_id IS NOT NULL))) AS required_set, list_distinct(list(artifact_id)) AS required_ids
             FROM sound LEFT JOIN (SELECT activity_kind, list_sort(list(document_kind)) AS needed FROM kinds GROUP BY activity_kind) n ON n.activity_kind = ik LEFT JOIN held USING (obligation_id) GROUP BY sound.obligation_id),
    r45v AS MATERIALIZED (SELECT r45.*, CASE WHEN needed IS NULL THEN 'REQUIREMENT_UNDEFINED' WHEN len(missing) = 0 THEN 'REQUIRED_KINDS_PRESENT' WHEN complete.a THEN 'KIND_MISSING' ELSE 'KIND_ABSENCE_UNCONFIRMED' END AS r4_reason,
             CASE WHEN n_files = 0 THEN NULL WHEN n_away > 0 THEN CASE WHEN complete.e THEN 'FILE_ABSENT' ELSE 'NOT_CAPTURED' END WHEN n_unreadable > 0 THEN 'FILE_UNREADABLE' WHEN n_large > 0 THEN 'FILE_TOO_LARGE'
                  WHEN complete.a THEN 'EVIDENCE_AVAILABLE' ELSE 'AVAILABILITY_UNCONFIRMED' END AS r5_reason FROM r45, complete),
    ready AS (SELECT * FROM r45v WHERE r4_reason = 'REQUIRED_KINDS_PRESENT' AND r5_reason = 'EVIDENCE_AVAILABLE'),
    bound AS (SELECT obligation_id, p.approval_id, p.decision, p.decided_at, p.evidence_digest, p.inspection_revision = irev AS now, p.inspection_revision AS for_revision, digest, required_set,
              (SELECT count(*) > 0 FROM lit x WHERE x.approval_id = p.approval_id) AS has_items,
              (SELECT list_sort(list_distinct(list(x.artifact_id || '@' || x.artifact_revision))) FROM lit x WHERE x.approval_id = p.approval_id AND list_contains(required_ids, x.artifact_id)) AS mine
              FROM ready LEFT JOIN lp p ON p.inspection_id = iid),
    classed AS MATERIALIZED (SELECT *, CASE WHEN now THEN coalesce(CASE WHEN evidence_digest IS NOT NULL THEN CASE WHEN evidence_digest = digest THEN 'MATCH' ELSE 'MISMATCH' END END, {by_items}, 'BINDING_UNAVAILABLE') END AS class FROM bound),
    latest AS (SELECT obligation_id, max(decided_at) AS t FROM classed WHERE class = 'MATCH' GROUP BY obligation_id),
    decided AS (SELECT obligation_id, count(approval_id) AS n, count(class) AS n_now, any_value(t) AS t,
                arg_min(class, (decided_at, approval_id)) FILTER (WHERE class LIKE 'BINDING%' AND (t IS NULL OR decided_at > t)) AS doubt,
                count(DISTINCT decision) FILTER (WHERE class = 'MATCH' AND decided_at = t) AS n_decisions, max(decision) FILTER (WHERE class = 'MATCH' AND decided_at = t) AS decision
                FROM classed LEFT JOIN latest USING (obligation_id) GROUP BY obligation_id),
    r6 AS (SELECT obligation_id, CASE WHEN NOT complete.p THEN 'APPROVAL_UNCONFIRMED' WHEN n = 0 THEN 'NO_APPROVAL' WHEN n_now = 0 THEN 'REVISION_NOT_APPROVED' WHEN doubt IS NOT NULL THEN doubt
             WHEN t IS NULL THEN 'EVIDENCE_CHANGED_SINCE_APPROVAL' WHEN n_decisions > 1 THEN 'CONFLICTING_DECISIONS' WHEN decision = 'approved' THEN 'APPROVAL_COVERS_CURRENT'
             WHEN decision = 'rejected' THEN 'APPROVAL_REJECTED' ELSE 'APPROVAL_REVOKED' END AS r6_reason FROM decided, complete),
    chain AS MATERIALIZED (SELECT r2.obligation_id, r2_reason, r2_blocked, coalesce(r3_reason, 'BLOCKED_BY_UPSTREAM') AS r3_reason, coalesce(r4_reason, 'BLOCKED_BY_UPSTREAM') AS r4_reason,
             coalesce(r5_reason, 'BLOCKED_BY_UPSTREAM') AS r5_reason, coalesce(r6_reason, 'BLOCKED_BY_UPSTREAM') AS r6_reason,
             CASE WHEN r3_reason IS NULL THEN ['R2:obligation:' || r2.obligation_id] ELSE [] END AS r3_blocked, CASE WHEN r4_reason IS NULL THEN ['R3:obligation:' || r2.obligation_id] ELSE [] END AS r4_blocked,
             CASE WHEN r4_reason IS NULL THEN ['R3:obligation:' || r2.obligation_id] WHEN r5_reason IS NULL THEN ['R4:obligation:' || r2.obligation_id] ELSE [] END AS r5_blocked,
             CASE WHEN r6_reason IS NOT NULL THEN [] ELSE list_filter([CASE WHEN coalesce(r4_reason, '') <> 'REQUIRED_KINDS_PRESENT' THEN 'R4:obligation:' || r2.obligation_id END,
                  CASE WHEN coalesce(r5_reason, '') <> 'EVIDENCE_AVAILABLE' THEN 'R5:obligation:' || r2.obligation_id END], lambda x: x IS NOT NULL) END AS r6_blocked,
             n_current, n_superseded, coalesce(n_mismatches, 0) AS n_mismatches, missing, n_files, CASE WHEN r5_reason = 'EVIDENCE_AVAILABLE' THEN digest END AS digest
             FROM r2 LEFT JOIN r3 USING (obligation_id) LEFT JOIN r45v USING (obligation_id) LEFT JOIN r6 USING (obligation_id))"""


def strings(e: str) -> str:
    """JSON text of a list of plain strings."""
    return f"""('[' || CASE WHEN len(coalesce({e}, [])) > 0 THEN '"' || array_to_string({e}, '","') || '"' ELSE '' END || ']')"""


def payloads(binding: str = "digest") -> str:
    """CTE ``payloads``: what the findings of R2 to R6 expected and observed, as canonical JSON; to stand after ``chain``."""
    entry = """'{"artifact_id":"' || split_part(x, '@', 1) || '","revision":"' || split_part(x, '@', 2) || '"}'"""
    off = lambda r, text: f"CASE WHEN {r}_reason = 'BLOCKED_BY_UPSTREAM' THEN '{{}}' ELSE {text} END"
    member = {
        "r2": ("""'{"current_completed_inspections":1}'""", f"""'{{"current_inspections":' || {strings('cur')} || ',"superseded_revisions":' || n_superseded || '}}'"""),
        "r3": ("""'{"activity_kind":"' || ok || '","asset_id":"' || oa || '","project_id":"' || op || '"}'""", """'{"mismatches":[' || coalesce(wrong, '') || ']}'"""),
        "r4": (f"""'{{"document_kinds":' || CASE WHEN needed IS NULL THEN 'null' ELSE {strings('needed')} END || '}}'""",
               f"""'{{"kinds":{{' || coalesce(witnesses, '') || '}},"missing_kinds":' || {strings('missing')} || '}}'"""),
        "r5": ("""'{"files":' || n_files || '}'""", """'{"files":[' || coalesce(probes, '') || ']}'"""),
        "r6": (f"""'{{"approved_artifact_revisions":[' || CASE WHEN changed THEN coalesce(wrong_revisions, '') ELSE '' END || '],"approved_evidence_digests":' || CASE WHEN changed THEN {strings('wrong_digests')} ELSE '[]' END || '}}'""",
               f"""'{{' || CASE WHEN r6_reason = 'REVISION_NOT_APPROVED' THEN '"approved_revisions":' || {strings('for_revisions')} || ',' ELSE '' END
                || '"binding":"' || CASE WHEN r6_reason IN ('APPROVAL_UNCONFIRMED', 'NO_APPROVAL', 'REVISION_NOT_APPROVED') OR len(coalesce(bindings, [])) = 0 THEN '{binding}' WHEN len(bindings) = 1 THEN bindings[1] ELSE 'mixed' END
                || '","current_artifact_revisions":[' || revs || '],"current_evidence_digest":"' || digest || '","decision_approvals":'
                || CASE WHEN r6_reason LIKE 'BINDING%' THEN {strings('[doubtful]')} WHEN changed THEN {strings('stale')} WHEN r6_reason IN ('APPROVAL_UNCONFIRMED', 'NO_APPROVAL', 'REVISION_NOT_APPROVED') THEN '[]' ELSE {strings('deciding')} END || '}}'"""),
    }
    return f"""
    mm AS (SELECT obligation_id, 'inspection:' || iid || '@' || irev AS subject, 'project_id' AS field, op AS expected, ip AS observed FROM cand WHERE ip <> op
           UNION ALL SELECT obligation_id, 'inspection:' || iid || '@' || irev, 'asset_id', oa, ia FROM cand WHERE ia <> oa
           UNION ALL SELECT obligation_id, 'inspection:' || iid || '@' || irev, 'activity_kind', ok, ik FROM cand WHERE ik <> ok
           UNION ALL SELECT obligation_id, 'artifact:' || artifact_id || '@' || la.revision, 'project_id', op, la.project_id FROM cand JOIN la ON la.inspection_id = iid AND la.is_current WHERE la.project_id <> op
           UNION ALL SELECT obligation_id, 'artifact:' || artifact_id || '@' || la.revision, 'asset_id', oa, la.asset_id FROM cand JOIN la ON la.inspection_id = iid AND la.is_current WHERE la.asset_id <> oa),
    mmj AS (SELECT obligation_id, string_agg('{{"expected":"' || expected || '","field":"' || field || '","observed":"' || observed || '","subject":"' || subject || '"}}', ',' ORDER BY subject, field) AS wrong FROM mm GROUP BY obligation_id),
    wit AS (SELECT obligation_id, string_agg('"' || document_kind || '":[' || ids || ']', ',' ORDER BY document_kind) AS witnesses FROM
            (SELECT obligation_id, document_kind, string_agg('"' || artifact_id || '"', ',' ORDER BY artifact_id) AS ids FROM held GROUP BY ALL) GROUP BY obligation_id),
    fil AS (SELECT obligation_id, string_agg('{{"artifact":"' || artifact_id || '@' || revision || '",' || coalesce('"sha256":"' || sha256 || '",', '') || '"status":"' || status || '"}}', ',' ORDER BY artifact_id || '@' || revision) AS probes,
                   string_agg('{{"artifact_id":"' || artifact_id || '","revision":"' || revision || '"}}', ',' ORDER BY artifact_id, revision) AS revs FROM held GROUP BY obligation_id),
    app AS (SELECT obligation_id, list_sort(list_distinct(list(for_revision) FILTER (WHERE for_revision IS NOT NULL))) AS for_revisions,
                   list_sort(list_distinct(list(CASE WHEN evidence_digest IS NOT NULL THEN 'digest' ELSE 'revisions' END) FILTER (WHERE class IN ('MATCH', 'MISMATCH')))) AS bindings,
                   list_sort(list_distinct(list(evidence_digest) FILTER (WHERE class = 'MISMATCH' AND evidence_digest IS NOT NULL))) AS wrong_digests,
                   array_to_string(list_sort(list_distinct(list('[' || array_to_string(list_transform(coalesce(mine, []), lambda x: {entry}), ',') || ']') FILTER (WHERE class = 'MISMATCH' AND evidence_digest IS NULL))), ',') AS wrong_revisions,
                   arg_min(approval_id, (decided_at, approval_id)) FILTER (WHERE class LIKE 'BINDING%' AND (t IS NULL OR decided_at > t)) AS doubtful,
                   list_sort(list_distinct(list(approval_id) FILTER (WHERE class = 'MISMATCH'))) AS stale,
                   list_sort(list_distinct(list(approval_id) FILTER (WHERE class = 'MATCH' AND decided_at = t))) AS deciding
            FROM classed LEFT JOIN latest USING (obligation_id) GROUP BY obligation_id),
    side AS (SELECT c.*, cur, op, oa, ok, needed, wrong, witnesses, probes, revs, app.* EXCLUDE (obligation_id), r6_reason = 'EVIDENCE_CHANGED_SINCE_APPROVAL' AS changed
             FROM chain c JOIN (SELECT obligation_id, cur, op, oa, ok FROM r2) x USING (obligation_id) LEFT JOIN (SELECT obligation_id, needed FROM r45v) y USING (obligation_id)
             LEFT JOIN mmj USING (obligation_id) LEFT JOIN wit USING (obligation_id) LEFT JOIN fil USING (obligation_id) LEFT JOIN app USING (obligation_id)),
    payloads AS ({" UNION ALL ".join(f"SELECT '{r.upper()}:obligation:' || obligation_id AS key, {off(r, e)} AS expected, {off(r, o)} AS observed FROM side" for r, (e, o) in member.items())})"""


def citations() -> str:
    """CTE ``citations``: the rows that each finding cites; to stand after ``chain``."""
    on = lambda r: f"{r}_reason <> 'BLOCKED_BY_UPSTREAM'"
    key = lambda r: f"'{r.upper()}:obligation:' || j.obligation_id"
    parts = [f"SELECT {key(r)} AS key, 'scope' AS dataset, ls.locator FROM judged j JOIN ls USING (obligation_id) WHERE {on(r)}" for r in ("r2", "r3")]
    parts.append(f"SELECT {key('r2')}, 'inspections', li.locator FROM judged j JOIN li ON li.obligation_id = j.obligation_id WHERE {on('r2')}")
    parts += [f"SELECT {key(r)}, 'inspections', li.locator FROM judged j JOIN li ON li.inspection_id = iid AND li.revision = irev WHERE {on(r)}" for r in ("r3", "r4", "r5", "r6")]
    parts.append(f"SELECT {key('r3')}, 'artifacts', la.locator FROM judged j JOIN la ON la.inspection_id = iid AND la.is_current WHERE {on('r3')}")
    parts += [f"SELECT {key(r)}, 'artifacts', la.locator FROM judged j JOIN la ON la.inspection_id = iid AND la.is_current JOIN kinds k ON k.activity_kind = ik AND k.document_kind = la.document_kind WHERE {on(r)}" for r in ("r4", "r5")]
    parts.append(f"SELECT {key('r6')}, 'approvals', lp.locator FROM judged j JOIN lp ON lp.inspection_id = iid WHERE {on('r6')}")
    parts.append(f"SELECT {key('r6')}, 'approval_items', lit.locator FROM judged j JOIN lp ON lp.inspection_id = iid JOIN lit ON lit.approval_id = lp.approval_id WHERE {on('r6')}")
    parts.append("SELECT 'R7:inspection:' || inspection_id, 'inspections', locator FROM li WHERE is_current AND NOT EXISTS (SELECT 1 FROM obligations o WHERE o.obligation_id = li.obligation_id)")
    parts.append(f"SELECT 'R1:project:{PROJECT}', 'scope', locator FROM v_scope")
    parts.append("SELECT 'R0:' || kind || ':' || subject || '#' || code, dataset, locator FROM defects")
    return f"""
    judged AS (SELECT c.*, iid, irev, ik FROM chain c JOIN (SELECT obligation_id, iid, irev, ik FROM r2) USING (obligation_id)),
    citations AS (SELECT DISTINCT key, dataset, locator FROM ({" UNION ALL ".join(parts)}))"""


def bodies() -> str:
    """Every row's dataset, subject and canonical JSON."""
    parts = []
    for name, spec in DATASETS.items():
        shown = {f.name: f"CASE WHEN {f.name} THEN 'true' WHEN NOT {f.name} THEN 'false' ELSE 'null' END" if f.kind == "bool" else f"coalesce('\"' || {f.name} || '\"', 'null')" for f in spec.fields}
        raw = json_of({f.name: f"raw_{f.name}" for f in spec.fields})
        codes = [f"CASE WHEN r_{f.name} LIKE 'path:%' THEN 'INVALID_PATH' WHEN r_{f.name} IS NOT NULL THEN 'INVALID_VALUE' END" for f in spec.fields]
        listed = f"list_sort(list_distinct(list_filter([{', '.join(codes)}, CASE WHEN copies IS NOT NULL THEN 'DUPLICATE_KEY' END], lambda x: x IS NOT NULL)))"
        source = f"v_{name}"
        if name == "artifacts":
            del shown["relative_path"]
            status = "CASE WHEN v.relative_path IS NULL THEN 'no_path' ELSE coalesce(f.status, 'absent') END"
            shown["evidence"] = f"""CASE WHEN {status} = 'present' THEN '{{"sha256":"' || f.sha256 || '","status":"present"}}' ELSE '{{"status":"' || {status} || '"}}' END"""
            source = "v_artifacts v LEFT JOIN files f USING (relative_path)"
        plain = "'{' || " + " || ',' || ".join(f"""'"{k}":' || {e}""" for k, e in sorted(shown.items())) + " || '}'"
        parts.append(f"""SELECT '{name}' AS dataset, subject, CASE WHEN quarantined THEN '{{"quarantined":' || {strings(listed)} || ',"raw":' || {raw} || '}}' ELSE {plain} END AS body FROM {source}""")
    return " UNION ALL ".join(parts)


def snapshot() -> str:
    """CTE ``snapshot``: digest of each dataset, by a tree over the hashes of its canonical rows."""
    levels, at = "", "leaf"
    for k, digits in enumerate((8, 5, 2, 0)):
        levels += f", level{k} AS (SELECT dataset, substr(node, 1, {digits}) AS node, sha256(string_agg(digest, ',' ORDER BY digest)) AS digest FROM {at} GROUP BY ALL)"
        at = f"level{k}"
    return f"""
    hashed AS (SELECT dataset, sha256(body) AS h, count(*) AS n FROM ({bodies()}) GROUP BY ALL),
    leaf AS (SELECT dataset, h AS node, sha256(h || ':' || n) AS digest FROM hashed){levels},
    snapshot AS (SELECT dataset, CAST(n_rows AS BIGINT) AS n_rows, digest FROM {at} JOIN (SELECT dataset, sum(n) AS n_rows FROM hashed GROUP BY dataset) USING (dataset))"""


PASSES = "('SINGLE_CURRENT_COMPLETED', 'IDENTITY_CONSISTENT', 'REQUIRED_KINDS_PRESENT', 'EVIDENCE_AVAILABLE', 'APPROVAL_COVERS_CURRENT')"
UNSURE = "('CARDINALITY_UNCONFIRMED', 'ABSENCE_UNCONFIRMED', 'IDENTITY_UNCONFIRMED', 'KIND_ABSENCE_UNCONFIRMED', 'REQUIREMENT_UNDEFINED', 'NOT_CAPTURED', 'FILE_UNREADABLE', 'FILE_TOO_LARGE', 'AVAILABILITY_UNCONFIRMED', 'APPROVAL_UNCONFIRMED', 'CONFLICTING_DECISIONS', 'BINDING_STRENGTH_INSUFFICIENT', 'BINDING_UNAVAILABLE')"
CAUSE = "CASE WHEN reason IN ('CARDINALITY_UNCONFIRMED', 'ABSENCE_UNCONFIRMED') THEN 'R1:dataset:inspections' WHEN reason = 'NOT_CAPTURED' THEN 'R1:dataset:evidence_files' WHEN reason = 'APPROVAL_UNCONFIRMED' THEN 'R1:dataset:approvals' WHEN reason IN ('IDENTITY_UNCONFIRMED', 'KIND_ABSENCE_UNCONFIRMED', 'AVAILABILITY_UNCONFIRMED') THEN 'R1:dataset:artifacts' END"


def outcome(reason: str) -> str:
    return f"CASE WHEN {reason} = 'BLOCKED_BY_UPSTREAM' THEN 'NOT_EVALUATED' WHEN {reason} IN {PASSES} THEN 'PASS' WHEN {reason} IN {UNSURE} THEN 'UNKNOWN' ELSE 'FAIL' END"


FINDINGS = f"""
    five AS (SELECT 'R2' AS check_id, obligation_id, r2_reason AS reason, r2_blocked AS blocked_by FROM chain {" ".join(f"UNION ALL SELECT 'R{k}', obligation_id, r{k}_reason, r{k}_blocked FROM chain" for k in range(3, 7))}),
    loose AS (SELECT inspection_id FROM li WHERE is_current AND NOT EXISTS (SELECT 1 FROM obligations o WHERE o.obligation_id = li.obligation_id) GROUP BY inspection_id),
    findings AS MATERIALIZED (
        SELECT 'R0' AS check_id, kind AS subject_kind, subject AS subject_id, code AS code_suffix, outcome, code AS reason, required, CAST([] AS VARCHAR[]) AS blocked_by, CAST(NULL AS VARCHAR) AS caused_by, 'R0:' || kind || ':' || subject || '#' || code AS key FROM r0
        UNION ALL SELECT 'R1', 'project', '{PROJECT}', NULL, 'PASS', 'SCOPE_ESTABLISHED', TRUE, [], NULL, 'R1:project:{PROJECT}'
        UNION ALL SELECT 'R1', 'dataset', dataset, NULL, CASE WHEN len(reasons) = 0 THEN 'PASS' ELSE 'UNKNOWN' END, CASE WHEN len(reasons) = 0 THEN 'COVERAGE_COMPLETE' ELSE reasons[1] END, TRUE, [], NULL, 'R1:dataset:' || dataset FROM coverage
        UNION ALL SELECT check_id, 'obligation', obligation_id, NULL, {outcome('reason')}, reason, TRUE, blocked_by, {CAUSE}, check_id || ':obligation:' || obligation_id FROM five
        UNION ALL SELECT 'R7', 'inspection', inspection_id, NULL, 'FAIL', 'UNMATCHED_INSPECTION', FALSE, [], NULL, 'R7:inspection:' || inspection_id FROM loose)"""


def over_shapes(select: str, *more: str, dangling: bool = True, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{prelude(dangling)},\n{VALIDATED}" + "".join(f",\n{m}" for m in more) + f"\n{select}"


def over_integrity(select: str, dangling: bool = True) -> str:
    return over_shapes(select, INTEGRITY, LIVE, dangling=dangling)


def over_chain(select: str, binding: str = "digest", dangling: bool = False, recursive: bool = False) -> str:
    return over_shapes(select, chain(binding), FINDINGS, dangling=dangling, recursive=recursive)


def over_payloads(select: str, binding: str = "digest", dangling: bool = False) -> str:
    return over_shapes(select, chain(binding), payloads(binding), dangling=dangling)


