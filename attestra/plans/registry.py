"""Registered queries of the readiness engine and their DuckDB SQL.

The rules run over the benchmark tables seen as inspection records
(``sources.shapes``): once with every kind of defect, once with all references in
place, so that the whole chain is reached. An assessment is evaluated once for a
session and folder; queries that read the same one share it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, grammar
from ..functions.schema import DATASETS, SUBJECTS
from ..operators import adapter, chain, citations, coverage, expected, findings, identity, integrity, rules
from ..operators.case import Pack
from ..sources import evidence, pages, shapes, sinks, strict_csv
from ..sources.staging import scratch, staged
from . import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_DONE: dict[tuple, chain.Evaluated] = {}


def register(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def assessed(spark: SparkSession, sf_dir: str, binding: str = "digest", dangling: bool = False) -> chain.Evaluated:
    """The assessment, made once for a session and the files as they are, as far as queries ask for it."""
    key = (spark.sparkContext.applicationId, sf_dir, file_state(spark, sf_dir), binding, dangling)
    if key not in _DONE:
        _DONE[key] = chain.evaluate(shapes.case_of(spark, sf_dir, binding, dangling))
    return _DONE[key]


def file_state(spark: SparkSession, sf_dir: str) -> tuple:
    """One row about the files of the tables: it differs if any was written, added or taken away."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{sf_dir}/{t}.parquet" for t in shapes.TABLES])
    return tuple(files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def forget() -> None:
    """Evaluate anew from here on."""
    _DONE.clear()


def joined(c: str | Column) -> Column:
    return F.array_join(c, ",")


def step1(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Rows that pass the grammars; duplicates stay."""
    done = assessed(spark, sf_dir, dangling=True)
    return done.records.rows[name].where("size(violations) = 0 AND NOT malformed")


VALID = ", ".join(f"{a} AS (SELECT * FROM v_{n} WHERE n_bad = 0)" for a, n in (("si", "inspections"), ("sa", "artifacts"), ("ss", "scope")))


# --- grammars -------------------------------------------------------------------

WORD = "CASE {d} % 12 WHEN 0 THEN 'ID-' || {w} WHEN 1 THEN {w} WHEN 2 THEN ' ' || {w} WHEN 3 THEN lower({w}) || '_x' WHEN 4 THEN {w} || '.' WHEN 5 THEN {w} || chr(10) WHEN 6 THEN 'sha256:' || {sha} WHEN 7 THEN 'SHA256:' || {sha} WHEN 8 THEN repeat({w}, 20) WHEN 9 THEN '' WHEN 10 THEN {w} || chr(9) || 'x' ELSE {w} || ':v1-2' END"
WORDS_SPARK = "SELECT doc_id, " + WORD.format(d="doc_id", w="regexp_extract(text, '[A-Za-z]+', 0)", sha="sha2(text, 256)") + " AS s FROM {documents}"
WORDS_DUCK = "SELECT doc_id, " + WORD.format(d="doc_id", w="regexp_extract(text, '[A-Za-z]+')", sha="sha256(text)") + " AS s FROM documents"


@register(f"SELECT doc_id, {', '.join(f'regexp_full_match(s, $${p}$$) AS is_{k}' for k, p in oracle.GRAMMAR.items())}, length(s) BETWEEN 1 AND 200 AND NOT regexp_matches(s, '\\p{{Cc}}') AS is_text FROM ({WORDS_DUCK})")
def q_grammar_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.sql(WORDS_SPARK, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return words.select("doc_id", *[F.col("s").rlike(p).alias(f"is_{k}") for k, p in grammar.PATTERNS.items()], grammar.is_text(F.col("s")).alias("is_text"))


TIMES = """CASE event_id % 14 WHEN 0 THEN {t} || 'Z' WHEN 1 THEN {t} || '+02:30' WHEN 2 THEN {t} || '-23:59' WHEN 3 THEN {t} || '+24:00' WHEN 4 THEN {t} || '.5Z' WHEN 5 THEN {t} || '.1234567Z'
    WHEN 6 THEN {t} WHEN 7 THEN lower({t}) || 'Z' WHEN 8 THEN '0001-01-01T00:30:00+01:00' WHEN 9 THEN '2023-02-29T00:00:00Z' WHEN 10 THEN substr({t}, 1, 17) || '60Z' WHEN 11 THEN '0000-01-01T00:00:00Z'
    WHEN 12 THEN {t} || '.000001+23:59' ELSE {t} || 'Z' || chr(10) END"""


@register(f"SELECT event_id, {oracle.time('s')} AS utc FROM (SELECT event_id, {TIMES.format(t="strftime(ts, '%Y-%m-%dT%H:%M:%S')")} AS s FROM events)")
def q_parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = TIMES.format(t="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")")
    made = spark.sql(f"SELECT event_id, {text} AS s FROM {{events}}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return made.select("event_id", grammar.parse_ts(F.col("s")).alias("utc"))


PATHS = """CASE page_id % 14 WHEN 0 THEN '/' || u WHEN 1 THEN u WHEN 2 THEN replace(u, ':', '') WHEN 3 THEN 'a/' || split_part(u, '/', 3) || '.txt' WHEN 4 THEN 'a/../' || page_id WHEN 5 THEN 'docs/' || page_id || '.'
    WHEN 6 THEN 'docs/nul.txt' WHEN 7 THEN 'docs/com1 .x' WHEN 8 THEN repeat('a/', 130) || 'b' WHEN 9 THEN 'x/' || repeat('b', 101) WHEN 10 THEN 'a' || chr(9) || '?b' WHEN 11 THEN 'a?' || chr(9) WHEN 12 THEN 'docs//' || page_id ELSE 'docs/' || page_id || '/x.pdf' END"""


@register(f"SELECT page_id, {oracle.path('s')} AS rule FROM (SELECT page_id, {PATHS} AS s FROM (SELECT page_id, url AS u FROM pages))")
def q_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql(f"SELECT page_id, {PATHS} AS s FROM (SELECT page_id, url AS u FROM {{pages}})", pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return made.select("page_id", grammar.path_rule(F.col("s")).alias("rule"))


@register("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS digest, substr('sha256:' || sha256(coalesce(text, '')), 1, 19) AS short FROM documents")
def q_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.concat(F.lit("sha256:"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", digest.alias("digest"), F.substring(digest, 1, 19).alias("short"))


NAMES = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN split_part(url, '/', 3) || '...' WHEN 2 THEN '...' WHEN 3 THEN 'con.txt' WHEN 4 THEN repeat(url, 4) || '.pdf' ELSE 'été ' || page_id || '.jpg' END"


@register(f"""
    WITH a AS (SELECT page_id, {NAMES} AS raw FROM pages),
    b AS (SELECT *, regexp_replace(regexp_replace(raw, '[^A-Za-z0-9._-]', '_', 'g'), '\\.+$', '') AS t FROM a),
    c AS (SELECT *, CASE WHEN t = '' THEN 'file' ELSE t END AS u FROM b),
    d AS (SELECT *, CASE WHEN upper(string_split(u, '.')[1]) IN {oracle.RESERVED} THEN '_' || u ELSE u END AS v FROM c)
    SELECT page_id, CASE WHEN length(v) > 100 THEN substr(substr(v, 1, 83) || '~' || substr(sha256(raw), 1, 8) || regexp_extract(v, '.(\\.[^.]*)$', 1), 1, 100) ELSE v END AS name FROM d""")
def q_sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.sql(f"SELECT page_id, {NAMES} AS raw FROM {{pages}}", pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return made.select("page_id", grammar.sanitized_file_name(F.col("raw")).alias("name"))


# --- R0 -------------------------------------------------------------------------


@register(oracle.over_shapes(" UNION ALL ".join(f"SELECT '{n}' AS dataset, locator, '{f.name}' AS field, r_{f.name} AS rule, raw_{f.name} AS value FROM v_{n} WHERE r_{f.name} IS NOT NULL" for n, s in DATASETS.items() for f in s.fields)))
def q_validate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assessed(spark, sf_dir, dangling=True)
    parts = [rows.select("dataset", "locator", F.explode("violations").alias("v")).select("dataset", "locator", "v.field", "v.rule", "v.value") for rows in done.records.rows.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register(oracle.over_shapes(" UNION ALL ".join(f"SELECT '{n}' AS dataset, subject, copies, identical FROM g_{n}" for n in DATASETS)))
def q_r0_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir, dangling=True).records.repeated.select("dataset", "subject", "copies", "identical")


R0_COLUMNS = "kind, subject, code, outcome, required, CAST(n_rows AS BIGINT) AS n_rows"


def r0(spark: SparkSession, sf_dir: str, *codes: str) -> DataFrame:
    done = assessed(spark, sf_dir, dangling=True)
    rows = integrity.findings(done.defects_of(*codes), done.records, codes).select(F.col("subject_kind").alias("kind"), F.col("subject_id").alias("subject"), F.col("reason").alias("code"), "outcome", "required", "observed")
    return rows.where(F.col("code").isin(*codes)) if codes else rows


def _r0_sql(where: str, observed: str) -> str:
    return oracle.over_integrity(f"SELECT kind, subject, code, outcome, required, {observed} AS observed FROM r0 WHERE {where}")


LISTED = "'{\"count\":' || n_rows || ',\"%s\":[' || array_to_string(details, ',') || ']}'"


@register(_r0_sql("code IN ('INVALID_VALUE', 'INVALID_PATH', 'UNMAPPED_VALUE')", LISTED % "violations"))
def q_r0_invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r0(spark, sf_dir, *integrity.CELL_CODES)


@register(_r0_sql("code = 'MULTIPLE_CURRENT_REVISIONS'", "'{\"current_revisions\":[\"' || array_to_string(details, '\",\"') || '\"]}'"))
def q_r0_multiple_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r0(spark, sf_dir, "MULTIPLE_CURRENT_REVISIONS")


@register(_r0_sql("code = 'COMPLETED_WITHOUT_TIMESTAMP'", "'{\"count\":' || n_rows || '}'"))
def q_completed_without_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r0(spark, sf_dir, "COMPLETED_WITHOUT_TIMESTAMP")


@register(_r0_sql("code = 'TIMESTAMP_AFTER_AS_OF'", "'{\"count\":' || n_rows || ',' || substr(details[1], 2)"))
def q_ts_after_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r0(spark, sf_dir, "TIMESTAMP_AFTER_AS_OF")


@register(_r0_sql("code = 'DANGLING_REFERENCE' AND kind IN ('artifact', 'approval')", LISTED % "missing"))
def q_r0_dangling_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r0(spark, sf_dir, "DANGLING_REFERENCE").where("kind IN ('artifact', 'approval')")


@register(_r0_sql("code = 'DANGLING_REFERENCE' AND kind = 'approval_item'", LISTED % "missing"))
def q_r0_dangling_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r0(spark, sf_dir, "DANGLING_REFERENCE").where("kind = 'approval_item'")


@register(oracle.over_integrity(f"SELECT {R0_COLUMNS} FROM r0"))
def q_r0_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assessed(spark, sf_dir, dangling=True)
    n = done.defects.groupBy("kind", "subject", "code").agg(F.countDistinct("dataset", "locator").alias("n_rows"))
    return r0(spark, sf_dir).drop("observed").join(n, ["kind", "subject", "code"])


@register(oracle.over_integrity("SELECT code, required, count(*) AS n FROM r0 GROUP BY ALL"))
def q_r0_requiredness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r0(spark, sf_dir).groupBy("code", "required").agg(F.count("*").alias("n"))


@register(oracle.over_integrity(" UNION ALL ".join(f"SELECT '{n}' AS dataset, locator, array_to_string(obligations, ',') AS obligations, lost AS unattributable FROM a_{n}" for n in DATASETS)))
def q_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assessed(spark, sf_dir, dangling=True)
    out = None
    for n in DATASETS:
        part = integrity.attributed(done.records, n).select(F.lit(n).alias("dataset"), "locator", joined("obligations").alias("obligations"), "unattributable")
        out = part if out is None else out.unionByName(part)
    return out


@register(oracle.over_integrity("SELECT obligation_id, array_to_string(keys, ',') AS keys FROM blocking"))
def q_r0_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assessed(spark, sf_dir, dangling=True)
    return integrity.blocking(done.defects, done.records).select("obligation_id", joined("keys").alias("keys"))


@register(oracle.over_integrity("SELECT obligation_id FROM obligations"))
def q_scope_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir, dangling=True).records.obligations


@register(oracle.over_integrity("SELECT dataset, count(*) AS n FROM lost_rows GROUP BY dataset"))
def q_unattributable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.unattributable(assessed(spark, sf_dir, dangling=True).records)


@register(oracle.over_integrity("SELECT dataset, count(*) AS n FROM wrong GROUP BY dataset"))
def q_contradicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.contradicted(assessed(spark, sf_dir, dangling=True).defects)


# --- R1 -------------------------------------------------------------------------

EFFECT = "CASE WHEN len(reasons) = 0 THEN 'complete_for_declared_scope' ELSE 'partial' END"


@register(oracle.over_integrity(f"SELECT dataset, array_to_string(reasons, ',') AS reasons, {EFFECT} AS effective FROM coverage"))
def q_effective_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir, dangling=True).coverage.select("dataset", joined("reasons").alias("reasons"), "effective")


@register(oracle.over_integrity("SELECT dataset AS subject_id, CASE WHEN len(reasons) = 0 THEN 'PASS' ELSE 'UNKNOWN' END AS outcome, coalesce(reasons[1], 'COVERAGE_COMPLETE') AS reason FROM coverage"))
def q_r1_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.dataset_findings(assessed(spark, sf_dir, dangling=True).coverage).select("subject_id", "outcome", "reason")


@register(oracle.over_integrity(f"""
    SELECT '{shapes.PROJECT}' AS subject_id, CASE WHEN reason = 'SCOPE_ESTABLISHED' THEN 'PASS' ELSE 'UNKNOWN' END AS outcome, reason, n AS obligations FROM (
        SELECT count(DISTINCT obligation_id) AS n, CASE WHEN bool_or(NOT keyed) THEN 'SCOPE_INVALID' WHEN count(DISTINCT obligation_id) = 0 THEN 'SCOPE_EMPTY'
               WHEN bool_or(NOT quarantined AND scope_revision <> '{shapes.REVISION}') THEN 'SCOPE_REVISION_MISMATCH' WHEN bool_or(NOT quarantined AND project_id <> '{shapes.PROJECT}') THEN 'SCOPE_PROJECT_MISMATCH'
               ELSE 'SCOPE_ESTABLISHED' END AS reason FROM v_scope)"""))
def q_r1_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assessed(spark, sf_dir, dangling=True)
    case = done.case
    found = coverage.project_finding(case, done.records)
    return found.select("subject_id", "outcome", "reason", F.get_json_object("observed", "$.obligation_count").cast("long").alias("obligations"))


BASIS_ROWS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'attested_export' WHEN 1 THEN 'query_total_matched,two_pass_stable' WHEN 2 THEN 'query_total_matched,two_pass_stable,operator_attestation' WHEN 3 THEN 'other,attested_export' ELSE '' END AS s FROM "


@register(f"SELECT event_id, list_has_all(string_split(s, ','), ['attested_export']) OR list_has_all(string_split(s, ','), ['query_total_matched', 'two_pass_stable', 'operator_attestation']) AS accepted FROM ({BASIS_ROWS} events)")
def q_basis_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(BASIS_ROWS + "{events}", events=spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("basis", F.split("s", ","))
    return rows.select("event_id", coverage.accepted_basis(Pack("", "", {}, shapes.BASES)).alias("accepted"))


# --- R2 to R4, R7 over rows that pass the grammars -----------------------------------


@register(oracle.over_shapes("""
    SELECT s.obligation_id, count(i.inspection_id) AS current_count, CASE WHEN count(i.inspection_id) = 0 THEN 'NO_CURRENT_INSPECTION' WHEN count(i.inspection_id) > 1 THEN 'MULTIPLE_CURRENT'
           WHEN count(*) FILTER (WHERE i.completion_status = 'completed') = 1 THEN 'SINGLE_CURRENT_COMPLETED' ELSE 'NOT_COMPLETED' END AS r2_reason
    FROM (SELECT DISTINCT obligation_id FROM ss) s LEFT JOIN si i ON i.obligation_id = s.obligation_id AND i.is_current GROUP BY s.obligation_id""", VALID))
def q_r2_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = step1(spark, sf_dir, "scope").dropDuplicates(["obligation_id"])
    found = rules.cardinality(scope, step1(spark, sf_dir, "inspections"))
    return found.select("obligation_id", F.col("n_current").alias("current_count"), rules.r2_verdict(True)[1].alias("r2_reason"))


@register(oracle.over_shapes("SELECT s.obligation_id, count(i.inspection_id) AS superseded FROM (SELECT DISTINCT obligation_id FROM ss) s LEFT JOIN si i ON i.obligation_id = s.obligation_id AND NOT i.is_current GROUP BY s.obligation_id", VALID))
def q_r2_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = step1(spark, sf_dir, "scope").dropDuplicates(["obligation_id"])
    return rules.cardinality(scope, step1(spark, sf_dir, "inspections")).select("obligation_id", F.col("n_superseded").alias("superseded"))


SINGLE = """cand AS (SELECT s.*, i.inspection_id, i.revision AS i_revision, i.project_id AS i_project, i.asset_id AS i_asset, i.activity_kind AS i_activity, i.completion_status
    FROM (SELECT DISTINCT obligation_id, project_id, asset_id, activity_kind FROM ss) s JOIN si i ON i.obligation_id = s.obligation_id AND i.is_current
    WHERE (SELECT count(*) FROM si x WHERE x.obligation_id = s.obligation_id AND x.is_current) = 1)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.single_candidates(step1(spark, sf_dir, "scope").dropDuplicates(["obligation_id"]), step1(spark, sf_dir, "inspections"))


@register(oracle.over_shapes("SELECT obligation_id, inspection_id, i_revision AS revision FROM cand", VALID, SINGLE))
def q_single_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("obligation_id", "inspection_id", "revision")


@register(oracle.over_shapes("""
    SELECT obligation_id, 'inspection' AS subject, inspection_id AS subject_id, 'project_id' AS field FROM cand WHERE i_project <> project_id
    UNION ALL SELECT obligation_id, 'inspection', inspection_id, 'asset_id' FROM cand WHERE i_asset <> asset_id
    UNION ALL SELECT obligation_id, 'inspection', inspection_id, 'activity_kind' FROM cand WHERE i_activity <> activity_kind
    UNION ALL SELECT obligation_id, 'artifact', a.artifact_id, 'project_id' FROM cand c JOIN sa a ON a.inspection_id = c.inspection_id AND a.is_current WHERE a.project_id <> c.project_id
    UNION ALL SELECT obligation_id, 'artifact', a.artifact_id, 'asset_id' FROM cand c JOIN sa a ON a.inspection_id = c.inspection_id AND a.is_current WHERE a.asset_id <> c.asset_id""", VALID, SINGLE))
def q_r3_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.mismatches(candidates(spark, sf_dir), step1(spark, sf_dir, "artifacts")).select("obligation_id", "subject", "subject_id", "field")


@register(oracle.over_shapes(f"""
    SELECT obligation_id, document_kind AS missing_kind FROM cand c JOIN (VALUES {oracle.KINDS}) AS k(activity_kind, document_kind) ON k.activity_kind = c.i_activity
    WHERE completion_status = 'completed' AND NOT EXISTS (SELECT 1 FROM sa a WHERE a.inspection_id = c.inspection_id AND a.is_current AND a.document_kind = k.document_kind)""", VALID, SINGLE))
def q_r4_missing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = rules.required_kinds(shapes.pack(), spark)
    return rules.missing_kinds(candidates(spark, sf_dir), step1(spark, sf_dir, "artifacts"), kinds)


@register(oracle.over_shapes("SELECT DISTINCT inspection_id FROM si WHERE is_current AND (obligation_id IS NULL OR obligation_id NOT IN (SELECT obligation_id FROM ss))", VALID))
def q_r7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unmatched(step1(spark, sf_dir, "inspections"), step1(spark, sf_dir, "scope")).select("inspection_id").distinct()


@register(oracle.over_shapes("""
    SELECT inspection_id, array_to_string(list_sort(list(revision)), ',') AS revisions, coalesce(array_to_string(list_sort(list_distinct(list(obligation_id))), ','), '') AS obligation_ids, bool_or(obligation_id IS NULL) AS unlinked
    FROM si WHERE is_current AND NOT EXISTS (SELECT 1 FROM ss WHERE ss.obligation_id = si.obligation_id) GROUP BY inspection_id""", VALID))
def q_r7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.unmatched_entities(step1(spark, sf_dir, "inspections"), step1(spark, sf_dir, "scope"))
    return found.select("inspection_id", joined("revisions").alias("revisions"), joined("obligation_ids").alias("obligation_ids"), F.exists("obligation_ids", lambda o: o.isNull()).alias("unlinked"))


# --- the chain -------------------------------------------------------------------


def of_check(check: str, dangling: bool = False, binding: str = "digest") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # these five checks are read off the chain, the first off its beginning; the other findings aren't needed
        done = assessed(spark, sf_dir, binding, dangling)
        rows = chain.obligation_findings(done.r2 if check == "R2" else done.chain, (check,))
        return rows.select("subject_id", "outcome", "reason", joined("blocked_by").alias("blocked_by"), joined("caused_by").alias("caused_by"))

    return run


for _check in ("R2", "R3", "R4", "R5", "R6"):
    _sql = f"SELECT subject_id, outcome, reason, coalesce(array_to_string(blocked_by, ','), '') AS blocked_by, coalesce(caused_by, '') AS caused_by FROM findings WHERE check_id = '{_check}'"
    QUERIES[f"q_{_check.lower()}_findings"], ORACLE_SQL[f"q_{_check.lower()}_findings"] = of_check(_check), oracle.over_chain(_sql)
    QUERIES[f"q_{_check.lower()}_findings_partial"], ORACLE_SQL[f"q_{_check.lower()}_findings_partial"] = of_check(_check, True), oracle.over_chain(_sql, dangling=True)
    if _check == "R6":
        QUERIES["q_r6_revision_binding"], ORACLE_SQL["q_r6_revision_binding"] = of_check(_check, binding="revisions"), oracle.over_chain(_sql, "revisions")


@register(oracle.over_shapes("SELECT key, dataset, locator FROM citations", oracle.chain(), oracle.citations(), dangling=True))
def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citations(assessed(spark, sf_dir, dangling=True))


@register(oracle.over_shapes("SELECT key, dataset, locator FROM citations", oracle.chain(), oracle.citations(), dangling=False))
def q_citations_whole_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citations(assessed(spark, sf_dir))


@register(oracle.over_shapes("SELECT dataset, n_rows, digest FROM snapshot", oracle.snapshot()))
def q_snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assessed(spark, sf_dir, dangling=True)
    return identity.snapshot_digest(done.case, done.records)


def _identity_sql() -> str:
    root = lambda n: f"coalesce('\"' || max(digest) FILTER (WHERE dataset = '{n}') || '\"', 'null')"
    claim = '{"basis":["' + '","'.join(sorted(shapes.BASES[0])) + '"],"consistency":"stable_verified","coverage":"complete_for_declared_scope"}'
    member = lambda n: f"""'"{n}":{{"declared":{claim},"rows":' || {root(n)} || '}}'"""
    datasets = f"""'"approval_items":{{"rows":' || {root('approval_items')} || '}},' || {member('approvals')} || ',' || {member('artifacts')} || ',"evidence_files":{{"declared":{claim}}},' || {member('inspections')}"""
    tail = f"""'}},"project":{{"project_id":"{shapes.PROJECT}"}},"scheme":"{identity.SCHEME}","scope":{{"accepted":true,"rows":' || {root('scope')} || ',"scope_revision":"{shapes.REVISION}"}}}}'"""
    return f"""SELECT 'sha256:' || sha256('{{"datasets":{{' || {datasets} || {tail}) AS digest FROM snapshot"""


@register(oracle.over_shapes(_identity_sql(), oracle.snapshot()))
def q_snapshot_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over all datasets' roots and what the snapshot declares."""
    done = assessed(spark, sf_dir, dangling=True)
    return identity.snapshot_identity(done.case, identity.snapshot_digest(done.case, done.records))


_SIDE = "SELECT dataset, coalesce(subject, sha256(body)) AS subject, sha256(body) AS h, count(*) AS n FROM (" + oracle.bodies() + ") GROUP BY ALL"


@register(f"""
    WITH before AS ({oracle.over_shapes(_SIDE)}), after AS ({oracle.over_shapes(_SIDE, dangling=False)}),
    d AS (SELECT dataset, subject, coalesce(a.n, 0) - coalesce(b.n, 0) AS more FROM before b FULL JOIN after a USING (dataset, subject, h) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0))
    SELECT dataset, subject, CASE WHEN min(more) > 0 THEN 'added' WHEN max(more) < 0 THEN 'removed' ELSE 'changed' END AS change,
           CAST(sum(greatest(-more, 0)) AS BIGINT) AS n_removed, CAST(sum(greatest(more, 0)) AS BIGINT) AS n_added FROM d GROUP BY dataset, subject""")
def q_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with defects in references, and without: which rows differ, by their kept trees."""
    kept = []
    for dangling in (True, False):
        done = assessed(spark, sf_dir, dangling=dangling)
        kept.append(scratch(spark, "snapshot-tree"))
        identity.keep_tree(done.case, done.records, kept[-1])
    return identity.snapshot_diff(spark, *kept)


@register(oracle.over_chain("SELECT count(*) AS findings, count(DISTINCT key) AS keys FROM findings", dangling=True))
def q_unique_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many keys as findings: the guard of the assessment, as counts."""
    found = assessed(spark, sf_dir, dangling=True).outcomes
    twice = findings.duplicate_findings(found).agg((F.count("*")).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return found.agg(F.count("*").alias("findings")).join(F.broadcast(twice)).select("findings", (F.col("findings") - F.col("n") + F.col("keys")).alias("keys"))


#: Every row of the five datasets as a CSV record, by its number: as it is, cells in quotes, cells with line ends and quotes in them, too many cells, text after a closing quote, a blank line before it.
CSV_KIND = "CASE row_number % 23 WHEN 3 THEN 'quoted' WHEN 7 THEN 'lines' WHEN 11 THEN 'ragged' WHEN 13 THEN 'broken' WHEN 17 THEN 'blank' ELSE 'plain' END"
CSV_PARTS = 4
#: Records of a file, or so: a part has as many files as it needs, and the last record, that is never closed, in one of them.
CSV_ROWS = 200_000


def _csv_sql() -> str:
    parts = []
    for name, spec in DATASETS.items():
        cells = [f"coalesce({f.name}, '')" for f in spec.fields]
        first = f"{cells[0]} || CASE WHEN kind = 'lines' THEN chr(10) || '\"x\"' || chr(13) || chr(10) || 'y' ELSE '' END"
        whole = " || '|' || ".join([first, *cells[1:]])
        parts.append(f"""SELECT '{name}' AS dataset, kind IN ('ragged', 'broken') AS malformed, TRUE AS numbered,
            CASE kind WHEN 'ragged' THEN {" || '|' || ".join(cells)} || '|more|and more' WHEN 'broken' THEN '"' || {cells[0]} || '"x,y' ELSE {whole} END AS body FROM (SELECT *, {CSV_KIND} AS kind FROM raw_{name})
            UNION ALL SELECT '{name}', TRUE, TRUE, '"never closed,' || chr(10) || 'a,b' FROM (SELECT DISTINCT row_number % {CSV_PARTS} FROM raw_{name})""")
    return " UNION ALL ".join(parts)


def csv_lines(rows: DataFrame, dataset: str, files: int = 1) -> DataFrame:
    """``part``, ``value``: a dataset's records as CSV text with defects, by file; each file has a header first, and the first of its part's ``files`` an unclosed quote last."""
    names = [f.name for f in DATASETS[dataset].fields]
    cells = [F.coalesce(c, F.lit("")) for c in names]
    kind = F.expr(CSV_KIND)
    quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]
    odd = F.concat(F.lit('"'), cells[0], F.lit('\n""x""\r\ny"'))
    of = (F.col("row_number") % CSV_PARTS).cast("string")
    part = F.concat_ws("_", of, F.pmod(F.xxhash64("row_number"), F.lit(files)).cast("string")).alias("part")
    number = F.lit("@")  # stands where x_source gets the record's place in its file
    text = (
        F.when(kind == "quoted", F.concat_ws(",", *quoted, number)).when(kind == "lines", F.concat_ws(",", odd, *cells[1:], number)).when(kind == "ragged", F.concat_ws(",", *cells, F.lit("more"), F.lit("and more")))
        .when(kind == "broken", F.concat(quoted[0], F.lit("x,y"))).when(kind == "blank", F.concat(F.lit("\n"), F.concat_ws(",", *cells, number))).otherwise(F.concat_ws(",", *cells, number))
    )
    body = rows.select(part, F.lit(1).alias("place"), text.alias("value"))
    made = rows.select(of.alias("of"), part).distinct()
    head = made.select("part", F.lit(0).alias("place"), F.lit(",".join([*names, "x_source"])).alias("value"))
    last = made.groupBy("of").agg(F.min("part").alias("part")).select("part", F.lit(2).alias("place"), F.lit('"never closed,\na,b').alias("value"))
    return body.unionByName(head).unionByName(last)


@register(oracle.over_shapes(_csv_sql()))
def q_strict_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five datasets written as CSV files with every kind of defect, and read by the strict source in blocks of 1 MB.

    ``numbered``: the record's number is its place in its file; malformed records have no cell to tell, so they stand for their neighbours.
    """
    raw = assessed(spark, sf_dir, dangling=True).case.raw
    out = None
    for name, spec in DATASETS.items():
        path = scratch(spark, f"{name}-csv")
        # a part's files are many, as each is written and numbered by one task
        files = max(1, raw[name].count() // (CSV_PARTS * CSV_ROWS))
        lines = csv_lines(raw[name], name, files).repartition("part").sortWithinPartitions("part", "place", "value")
        # a file's records are numbered in its task, as they are written; that of a part's first row is taken off
        told = staged(lines.withColumn("at", F.monotonically_increasing_id()), f"{name}-lines")
        first = F.broadcast(told.groupBy("part").agg(F.min("at").alias("first")))  # a row a file
        told = told.join(first, "part").withColumn("value", F.regexp_replace("value", r"@\z", F.concat(F.lit("row="), (F.col("at") - F.col("first") + 1).cast("string"))))
        told.repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)
        rows = strict_csv.read_dataset(spark, f"{path}/part=*", name, 1 << 20)
        cells = F.array_join(F.transform(F.array(*[F.coalesce(f.name, F.lit("")) for f in spec.fields]), lambda c: c), "|")
        numbered = F.coalesce(F.col("x_source") == F.concat(F.lit("row="), F.col("row_number").cast("string")), F.col("malformed"))
        body = F.when(F.col("malformed"), F.array_join("raw_cells", "|")).otherwise(cells)
        part = rows.select(F.lit(name).alias("dataset"), "malformed", numbered.alias("numbered"), body.alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


#: Of each part, its file and the path asked for: another case in the folder or (by full folding) in the name, one that isn't there, none, one out of the root, the folder itself, a path below a file, or its own.
PART_FILE = "'P' || CAST(p_partkey % 40 AS STRING) || '/' || CAST(p_partkey AS STRING) || '-straße.txt'"
PART_PATH = f"""CASE p_partkey % 13 WHEN 0 THEN replace({PART_FILE}, 'P', 'p') WHEN 1 THEN replace({PART_FILE}, 'straße.txt', 'STRASSE.TXT') WHEN 2 THEN {PART_FILE} || '.old' WHEN 3 THEN NULL
    WHEN 4 THEN '../' || {PART_FILE} WHEN 5 THEN 'P' || CAST(p_partkey % 40 AS STRING) WHEN 6 THEN {PART_FILE} || '/below' ELSE {PART_FILE} END"""


@register(f"""
    WITH f AS (SELECT p_partkey, {PART_FILE} AS file, {PART_PATH} AS path, p_name || chr(10) || p_type AS content FROM part),
    a AS (SELECT path, p_partkey % 13 AS way, CASE WHEN strlen(content) > 40 THEN 'too_large' ELSE 'present' END AS there, file, content FROM f)
    SELECT DISTINCT path AS relative_path, CASE WHEN way IN (0, 1, 2, 6) THEN 'absent' WHEN way = 3 THEN 'no_path' WHEN way IN (4, 5) THEN 'unreadable' ELSE there END AS status,
           CASE WHEN way > 6 AND there = 'present' THEN sha256(content) END AS sha256, CASE WHEN way IN (0, 1) THEN file END AS case_hint FROM a""")
def q_evidence_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each part, written and then probed by paths that hit or miss in every way."""
    root = scratch(spark, "part-files")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    evidence.write_files(part.selectExpr(f"{PART_FILE} AS relative_path", "p_name || '\n' || p_type AS content").repartition("relative_path"), root)
    return evidence.probe(part.selectExpr(f"{PART_PATH} AS relative_path"), root, 40)


#: Rows as they are written: every row's first cell, some with a line end, quotes and commas in it.
_ODD_CELL = "{c} || CASE row_number % 23 WHEN 7 THEN chr(10) || '\"x\",' WHEN 9 THEN ', ' WHEN 11 THEN '\"' ELSE '' END"


def _written_sql() -> str:
    parts = []
    for name, spec in DATASETS.items():
        cells = [_ODD_CELL.format(c=spec.fields[0].name), *[f"coalesce({f.name}, '')" for f in spec.fields[1:]]]
        parts.append(f"SELECT '{name}' AS dataset, {" || '|' || ".join(cells)} AS body, TRUE AS in_order FROM raw_{name}")
    return " UNION ALL ".join(parts)


@register(oracle.over_shapes(_written_sql()))
def q_written_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five datasets written as CSV in the order of their keys, and read back by the strict source. ``in_order``: no record comes before its file's last one."""
    raw, out = assessed(spark, sf_dir, dangling=True).case.raw, None
    for name, spec in DATASETS.items():
        path = scratch(spark, f"{name}-written")
        sinks.write_csv(raw[name].withColumn(spec.fields[0].name, F.expr(_ODD_CELL.format(c=spec.fields[0].name))), name, path)
        rows = strict_csv.read_dataset(spark, path, name)
        key = F.concat_ws("\x01", *[F.coalesce(k, F.lit("\U0010ffff")) for k in spec.key])
        place = Window.partitionBy("file").orderBy("row_number")  # a file is one range
        in_order = ~F.col("malformed") & (F.coalesce(F.lag(key).over(place), F.lit("")) <= key)
        part = rows.select(F.lit(name).alias("dataset"), F.array_join(F.array(*[F.coalesce(f.name, F.lit("")) for f in spec.fields]), "|").alias("body"), in_order.alias("in_order"))
        out = part if out is None else out.unionByName(part)
    return out


def _escaped(c: str) -> str:
    """DuckDB SQL of a text's JSON string, for the characters that stand in the tables and those planted."""
    for plain, shown in (("chr(92)", "chr(92) || chr(92)"), ("chr(34)", "chr(92) || chr(34)"), ("chr(10)", "chr(92) || 'n'"), ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'"), ("chr(31)", "chr(92) || 'u001f'"), ("chr(11)", "chr(92) || 'u000b'")):
        c = f"replace({c}, {plain}, {shown})"
    return f"'\"' || {c} || '\"'"


_PLANTED = "coalesce(text, '') || chr(31) || chr(92) || 'u001F' || chr(11) || chr(34) || chr(127) || '\U0001F600'"


@register(f"""
    WITH d AS (SELECT doc_id, {_PLANTED} AS t, coalesce(source, '') AS source FROM documents)
    SELECT doc_id, sha256('{{"A":null,"B":[{{"x":' || {_escaped('t')} || ',"y":' || doc_id || '.5}},[],{{}},[true,' || doc_id || ']],"a":{{"k":"v","k2":' || {_escaped('source')} || '}},"b":-0.25}}') AS sha256,
           'a number is no integer' AS outside FROM d""")
def q_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a nested object of unsorted keys, with control characters and escapes of its own, in canonical form."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(_PLANTED).alias("t"), F.coalesce("source", F.lit("")).alias("source"))
    n = F.col("doc_id").cast("string")
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    made = F.concat(F.lit('{"b": -0.250, "a": {"k2":'), quoted("source"), F.lit(', "k": "v"}, "B": [{"y": '), n, F.lit('.50, "x":'), quoted("t"), F.lit("}, [], {}, [true, "), n, F.lit(']], "A": null}'))
    text = docs.select("doc_id", canonical.canonical_json(F.parse_json(made)).alias("text"))
    return text.select("doc_id", F.sha2("text", 256).alias("sha256"), canonical.outside_domain(F.col("text")).alias("outside"))


_LISTED = "[" + ",".join(f"'{s}'" for s in SUBJECTS) + "]"


@register(oracle.over_chain(f"""
    , o AS (SELECT *, row_number() OVER (ORDER BY check_id, list_position({_LISTED}, subject_kind), subject_id, coalesce(code_suffix, '')) AS place FROM findings),
    j AS (SELECT place, '{{"blocked_by":' || {oracle.strings('blocked_by')} || ',"caused_by":' || CASE WHEN caused_by IS NULL THEN '[]' ELSE '["' || caused_by || '"]' END || ',"check_id":"' || check_id || '","key":"' || key || '","outcome":"' || outcome
          || '","reason":"' || reason || '","required":' || CAST(required AS VARCHAR) || ',"subject_id":"' || subject_id || '","subject_kind":"' || subject_kind || '"}}' AS json FROM o),
    t AS (SELECT count(*) AS n_findings, '{{"as_of":"{shapes.AS_OF}","findings":[' || chr(10) || string_agg(CASE WHEN place > 1 THEN ',' ELSE '' END || json || chr(10), '' ORDER BY place) || '],"project_id":"{shapes.PROJECT}"}}' || chr(10) AS text FROM j)
    SELECT n_findings, strlen(text) AS n_bytes, sha256(text) AS sha256 FROM t""", dangling=True).replace("\n\n    , o AS", ",\n o AS").replace("\n    , o AS", ",\n o AS"))
def q_assessment_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings as one JSON document in ranges of their order: its size and the digest of the joined files."""
    done = assessed(spark, sf_dir, dangling=True)
    path = scratch(spark, "assessment")
    shown = tuple(m for m in findings.MEMBERS if m not in ("expected", "observed"))
    rows = findings.as_json(done.outcomes, shown)
    manifest = sinks.write_json(rows, [f"by{k}" for k in range(4)], path, "findings", {"as_of": f'"{done.case.as_of}"', "project_id": f'"{done.case.project_id}"'})
    whole = sinks.joined_sha256(manifest, path)
    return done.outcomes.agg(F.count("*").alias("n_findings")).join(F.broadcast(manifest.agg(F.sum("length").alias("n_bytes")))).withColumn("sha256", F.lit(whole))


@register("SELECT l_orderkey, l_linenumber, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q_closed_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items looked up in a closed index of orders; a miss would end the run."""
    index = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    asked = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return adapter.closed_world(asked, index, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderdate")


def payloads(spark: SparkSession, sf_dir: str, binding: str = "digest", dangling: bool = False) -> DataFrame:
    """What each finding of R2 to R6 expected and observed, as canonical JSON."""
    found = chain.obligation_findings(assessed(spark, sf_dir, binding, dangling).chain)
    return findings.keyed(found).select("key", "expected", "observed")


@register(oracle.over_payloads("SELECT key, expected, observed FROM payloads"))
def q_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir)


@register(oracle.over_payloads("SELECT key, expected, observed FROM payloads", dangling=True))
def q_payloads_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir, dangling=True)


@register(oracle.over_payloads("SELECT key, expected, observed FROM payloads", "revisions"))
def q_payloads_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir, "revisions")


@register(oracle.over_chain("SELECT obligation_id, r2_reason, r3_reason, r4_reason, r5_reason, r6_reason FROM chain"))
def q_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).chain.select("obligation_id", "r2_reason", "r3_reason", "r4_reason", "r5_reason", "r6_reason")


@register(oracle.over_chain("SELECT obligation_id, digest FROM chain WHERE digest IS NOT NULL"))
def q_evidence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).evidence.where("digest IS NOT NULL").select("obligation_id", "digest")


@register(oracle.over_chain("SELECT obligation_id, coalesce(array_to_string(missing, ','), '') AS missing, CAST(n_files AS BIGINT) AS n_files FROM r45v"))
def q_r4_r5_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessed(spark, sf_dir).chain.where("n_files IS NOT NULL")
    return rows.select("obligation_id", F.coalesce(joined("missing"), F.lit("")).alias("missing"), F.col("n_files").cast("long").alias("n_files"))


@register(oracle.over_chain("SELECT obligation_id, approval_id, class FROM classed JOIN latest USING (obligation_id) WHERE class = 'MATCH' AND decided_at = t"))
def q_r6_latest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assessed(spark, sf_dir)
    case = done.case
    live = done.records.live
    kinds = rules.required_kinds(case.pack, spark)
    picked = done.chain.where("r3_outcome IN ('PASS', 'UNKNOWN')").select("obligation_id", "candidate.*")
    evidence = rules.required_evidence(picked, live("artifacts"), kinds, case.files)
    ready = rules.evidence_verdicts(picked, evidence, kinds, True, True).where("r4_outcome = 'PASS' AND r5_outcome = 'PASS'").select("obligation_id", "inspection_id", "revision", "digest", "required_set")
    matched = rules.classified_approvals(ready, live("approvals"), live("approval_items"), "digest").where("class = 'MATCH'")
    matched = staged(matched.select("obligation_id", "approval_id", "class", "decided_at"), "matched")  # read twice
    newest = matched.groupBy("obligation_id").agg(F.max("decided_at").alias("decided_at"))  # all of the last, not one of them
    return matched.join(newest, ["obligation_id", "decided_at"]).select("obligation_id", "approval_id", "class")


# --- findings ---------------------------------------------------------------------


@register(oracle.over_chain("SELECT key, check_id, outcome, reason, required FROM findings", dangling=True))
def q_all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.keyed(assessed(spark, sf_dir, dangling=True).outcomes).select("key", "check_id", "outcome", "reason", "required")


@register(oracle.over_chain("""
    SELECT outcome, 'by_outcome' AS tally, (SELECT count(*) FROM findings f WHERE f.outcome = o.outcome) AS n FROM (VALUES ('PASS'), ('FAIL'), ('UNKNOWN'), ('NOT_EVALUATED')) AS o(outcome)
    UNION ALL SELECT outcome, 'required', (SELECT count(*) FROM findings f WHERE f.outcome = o.outcome AND required) FROM (VALUES ('PASS'), ('FAIL'), ('UNKNOWN'), ('NOT_EVALUATED')) AS o(outcome)
    UNION ALL SELECT outcome, 'advisory', (SELECT count(*) FROM findings f WHERE f.outcome = o.outcome AND NOT required) FROM (VALUES ('PASS'), ('FAIL'), ('UNKNOWN'), ('NOT_EVALUATED')) AS o(outcome)
    UNION ALL SELECT outcome, 'roots', (SELECT count(*) FROM findings f WHERE f.outcome = o.outcome AND required AND caused_by IS NULL) FROM (VALUES ('FAIL'), ('UNKNOWN')) AS o(outcome)""", dangling=True))
def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.counts(assessed(spark, sf_dir, dangling=True).outcomes)


@register(oracle.over_chain("SELECT key FROM findings WHERE required AND outcome IN ('FAIL', 'UNKNOWN') AND caused_by IS NULL", dangling=True))
def q_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.roots(findings.keyed(assessed(spark, sf_dir, dangling=True).outcomes)).select("key")


@register(oracle.over_chain("SELECT CASE WHEN bool_or(outcome = 'FAIL') THEN 'BLOCKED' WHEN bool_or(outcome IN ('UNKNOWN', 'NOT_EVALUATED')) THEN 'UNKNOWN' ELSE 'READY_FOR_REVIEW' END AS status FROM findings WHERE required"))
def q_project_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.status(assessed(spark, sf_dir).outcomes)


@register(oracle.over_chain("""
    , edges AS (SELECT unnest(blocked_by) AS top, key AS below FROM findings), reach AS (SELECT top, below FROM edges UNION SELECT r.top, e.below FROM reach r JOIN edges e ON e.top = r.below)
    SELECT key, count(below) AS n FROM findings LEFT JOIN reach ON top = key GROUP BY key""", recursive=True).replace("\n\n    , edges", ",\n edges").replace("\n    , edges", ",\n edges"))
def q_blocks_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.blocks(assessed(spark, sf_dir).outcomes)


@register(oracle.over_chain("SELECT subject_id, " + ", ".join(f"max(outcome) FILTER (WHERE check_id = 'R{k}') AS \"R{k}\"" for k in range(2, 7)) + " FROM findings WHERE subject_kind = 'obligation' GROUP BY subject_id"))
def q_obligation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.grid(assessed(spark, sf_dir).outcomes)


@register(oracle.over_chain("""
    SELECT key, row_number() OVER (ORDER BY check_id, list_position(['snapshot','project','dataset','obligation','scope_row','inspection','artifact','approval','approval_item','unattributable_row'], subject_kind), subject_id, coalesce(code_suffix, '')) AS place
    FROM findings WHERE check_id IN ('R1', 'R7')"""))
def q_findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.numbered(assessed(spark, sf_dir).findings_of("R1", "R7"))


@register(oracle.over_chain("""
    SELECT key, row_number() OVER (ORDER BY check_id, list_position(['snapshot','project','dataset','obligation','scope_row','inspection','artifact','approval','approval_item','unattributable_row'], subject_kind), subject_id, coalesce(code_suffix, '')) AS place
    FROM findings"""))
def q_all_findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.numbered(assessed(spark, sf_dir).outcomes)


@register(oracle.over_shapes("SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN a.outcome = b.outcome AND a.reason = b.reason AND a.blocked = b.blocked THEN 'unchanged' ELSE 'changed' END AS change FROM before a FULL JOIN after b ON a.key = b.key",
    oracle.chain(), "before AS (SELECT 'R6:obligation:' || obligation_id AS key, " + oracle.outcome("r6_reason") + " AS outcome, r6_reason AS reason, r6_blocked AS blocked FROM chain WHERE CAST(substr(obligation_id, 3) AS BIGINT) % 7 <> 0)",
    "after AS (SELECT 'R6:obligation:' || obligation_id AS key, " + oracle.outcome("r6_reason") + " AS outcome, CASE WHEN r6_reason = 'APPROVAL_REJECTED' THEN 'APPROVAL_REVOKED' ELSE r6_reason END AS reason, r6_blocked AS blocked FROM chain WHERE CAST(substr(obligation_id, 3) AS BIGINT) % 5 <> 0)", dangling=False))
def q_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = assessed(spark, sf_dir).findings.where("check_id = 'R6'")
    number = F.substring("subject_id", 3, 20).cast("long")
    later = run.where(number % 5 != 0).withColumn("reason", F.when(F.col("reason") == "APPROVAL_REJECTED", "APPROVAL_REVOKED").otherwise(F.col("reason")))
    return findings.compare(run.where(number % 7 != 0), later).select("key", "change")


@register(oracle.over_chain("""
    , before AS (SELECT * FROM findings WHERE ascii(right(key, 1)) % 7 <> 0), after AS (SELECT * REPLACE (CASE WHEN reason = 'APPROVAL_REJECTED' THEN 'APPROVAL_REVOKED' ELSE reason END AS reason) FROM findings WHERE ascii(right(key, 1)) % 5 <> 0)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN a.outcome = b.outcome AND a.reason = b.reason AND a.blocked_by = b.blocked_by THEN 'unchanged' ELSE 'changed' END AS change
    FROM before a FULL JOIN after b ON a.key = b.key""").replace("\n\n    , before", ",\n before").replace("\n    , before", ",\n before"))
def q_compare_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = findings.keyed(assessed(spark, sf_dir).findings)
    number = F.ascii(F.substring("key", -1, 1))
    later = run.where(number % 5 != 0).withColumn("reason", F.when(F.col("reason") == "APPROVAL_REJECTED", "APPROVAL_REVOKED").otherwise(F.col("reason")))
    return findings.compare(run.where(number % 7 != 0), later).select("key", "change")


#: Ranges of a hundred orders each for every check, with a verdict by the range's number.
_WANTED = """SELECT CAST(row_number() OVER (ORDER BY c, b) AS INT) AS place, c || ':obligation:O-' || CAST(100 * b + 1 AS STRING) || '..' || CAST(100 * b + 100 AS STRING) AS key, c, b,
    CASE b % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'NOT_EVALUATED' END AS outcome,
    CASE b % 3 WHEN 0 THEN 'SINGLE_CURRENT_COMPLETED' WHEN 1 THEN 'NO_CURRENT_INSPECTION' ELSE 'BLOCKED_BY_UPSTREAM' END AS reason, b % 3 = 2 AS blocked
    FROM (SELECT DISTINCT o_orderkey // 100 AS b FROM orders) CROSS JOIN (SELECT 'R2' AS c UNION ALL SELECT 'R3' UNION ALL SELECT 'R4')"""


@register(oracle.over_chain(f"""
    , w AS ({_WANTED}),
    f AS (SELECT *, TRY_CAST(regexp_extract(key, 'O-([0-9]+)$', 1) AS BIGINT) AS n FROM findings),
    m AS (SELECT f.*, w.place, w.outcome AS wo, w.reason AS wr, CASE WHEN w.blocked THEN ['R2:obligation:' || f.subject_id] ELSE [] END AS wb
          FROM f LEFT JOIN w ON f.check_id = w.c AND f.subject_kind = 'obligation' AND f.n BETWEEN 100 * w.b + 1 AND 100 * w.b + 100 AND (length(CAST(100 * b + 1 AS STRING)) <> length(CAST(100 * b + 100 AS STRING)) OR length(CAST(f.n AS STRING)) = length(CAST(100 * b + 1 AS STRING))))
    SELECT key, CASE WHEN place IS NULL THEN 'unexpected' ELSE 'different' END AS problem, CAST(1 AS BIGINT) AS n FROM m
    WHERE CASE WHEN place IS NULL THEN outcome <> 'PASS' ELSE NOT (outcome = wo AND reason = wr AND blocked_by = wb AND caused_by IS NULL AND required) END
    UNION ALL SELECT w.key, 'missing', 100 - count(m.key) FROM w LEFT JOIN m ON m.place = w.place GROUP BY w.key HAVING count(m.key) < 100""").replace("\n\n    , w AS", ",\n w AS").replace("\n    , w AS", ",\n w AS"))
def q_expected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings against expectations given for ranges of a hundred orders each."""
    wanted = spark.sql(_WANTED.replace("//", "DIV").replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    blocked = F.when(F.col("blocked"), F.array(F.lit("R2:obligation:{id}"))).otherwise(F.array().cast("array<string>"))
    wanted = wanted.select("place", "key", "outcome", "reason", blocked.alias("blocked_by"), F.array().cast("array<string>").alias("caused_by"), F.lit(True).alias("required"))
    return expected.mismatches(assessed(spark, sf_dir).outcomes, staged(wanted, "expected"))


@register("SELECT o_custkey, CASE WHEN count(*) > 1 THEN min(o_orderkey) || ' (and ' || (count(*) - 1) || ' more)' ELSE CAST(min(o_orderkey) AS VARCHAR) END AS shown FROM (SELECT o_custkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS o_orderkey FROM orders) GROUP BY o_custkey")
def q_first_and_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.min(F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("first"), F.count("*").alias("n"))
    return keys.select("o_custkey", findings.first_and_more(F.col("first"), F.col("n")).alias("shown"))


# --- adapter -------------------------------------------------------------------------


@register("SELECT user_id AS rid, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("user_id").alias("rid"), F.floor(F.col("event_id") / 100).alias("page"), (F.col("event_id") % 100).alias("pos"), "event_id", "event_type")
    return adapter.first_occurrences(rows).select("rid", "event_id", "event_type")


@register("""
    SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_partkey % 10 = 9 THEN 'part ' || l_partkey WHEN l_partkey < 1 THEN CAST(l_partkey AS VARCHAR) WHEN p_partkey IS NULL THEN 'rid.parts.' || l_partkey ELSE p_name END AS resolved, p_partkey IS NULL AND l_partkey % 10 <> 9 AND l_partkey >= 1 AS unresolved
    FROM lineitem LEFT JOIN (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_name END AS p_name FROM part WHERE p_partkey % 6 <> 0) ON p_partkey = l_partkey AND l_partkey % 10 <> 9""")
def q_reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.when(F.col("l_partkey") % 10 == 9, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).when(F.col("l_partkey") % 10 == 8, F.concat(F.col("l_partkey").cast("string"), F.lit(".0"))).otherwise(F.col("l_partkey").cast("string"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("rid"), F.when(F.col("p_partkey") % 8 != 0, F.col("p_name")).alias("canonical"))
    out = adapter.resolved_references(lines.select("l_orderkey", "l_linenumber", "l_suppkey", text.alias("ref")), parts, "ref", "parts")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "resolved", "unresolved")


@register("SELECT event_id + 1 AS rid, event_id // 500 + 1 AS page, event_id % 500 AS pos, event_type, user_id AS user FROM events")
def q_export_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as export pages of 500 records, and two of their three fields read back."""
    path = scratch(spark, "export-pages")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pages.write_pages(events.select((F.col("event_id") + 1).alias("rid"), F.to_json(F.struct(F.col("event_type").alias("of"))).alias("f6"), F.col("user_id").cast("string").alias("f7"), F.to_json(F.array("props")).alias("f8")), path, 500)
    rows = pages.read_pages(spark, path, [6, 7], 4)
    return rows.select("rid", F.col("page").cast("long").alias("page"), F.col("pos").cast("long").alias("pos"), F.get_json_object("f6", "$.of").alias("event_type"), F.col("f7").cast("long").alias("user"))


STATUSES = {"purchase": "completed", "click": "in_progress", "view": "not_started"}


@register(f"SELECT event_id, CASE {' '.join(f"WHEN event_type = '{a}' THEN '{b}'" for a, b in STATUSES.items())} ELSE event_type END AS cell, event_type NOT IN ('purchase', 'click', 'view') AS unmapped FROM events")
def q_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell, unmapped = adapter.mapped_labels(F.col("event_type"), STATUSES)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", cell.alias("cell"), unmapped.alias("unmapped"))


@register(oracle.over_shapes("SELECT artifact_id, revision FROM sa WHERE is_current AND inspection_id IN (SELECT inspection_id FROM si WHERE obligation_id IN (SELECT obligation_id FROM ss))", VALID))
def q_in_scope_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.in_scope_artifacts(step1(spark, sf_dir, "artifacts"), step1(spark, sf_dir, "inspections"), step1(spark, sf_dir, "scope")).select("artifact_id", "revision")


@register("SELECT event_id AS rid, CASE WHEN event_id % 89 = 1 THEN 'vanished' WHEN event_id % 83 = 2 THEN 'appeared' ELSE 'modified' END AS change FROM events WHERE (event_id % 89 = 1) <> (event_id % 83 = 2) OR (event_id % 97 = 0 AND NOT (event_id % 89 = 1))")
def q_two_pass_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("rid"), F.col("event_type").alias("modified"))
    second = e.withColumn("modified", F.when(F.col("rid") % 97 == 0, F.concat(F.lit("x"), F.col("modified"))).otherwise(F.col("modified")))
    return adapter.unstable(e.where("rid % 83 <> 2"), second.where("rid % 89 <> 1"))


PAGE = "SELECT event_type AS \"table\", event_id // 1000 AS page, count(*) AS n FROM events GROUP BY ALL"


@register(f"""
    WITH p AS ({PAGE}), t AS (SELECT "table", page, n, sum(n) OVER (PARTITION BY "table") - coalesce(sum(n) OVER w, 0) + CASE WHEN page % 7 = 3 THEN 1 ELSE 0 END AS total,
        sum(n) OVER (PARTITION BY "table") + first_value(CASE WHEN page % 7 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY "table" ORDER BY page) - coalesce(sum(n) OVER w, 0) AS expected
        FROM p WINDOW w AS (PARTITION BY "table" ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT "table", page, CAST(expected AS BIGINT) AS expected, total = expected AS fits FROM t""")
def q_page_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pages = e.groupBy(F.col("event_type").alias("table"), F.floor(F.col("event_id") / 1000).alias("page")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("table").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("table")) - F.coalesce(F.sum("n").over(before), F.lit(0)) + F.when(F.col("page") % 7 == 3, 1).otherwise(0)
    return adapter.page_accounting(pages.withColumn("total", total)).select("table", "page", "expected", "fits")


@register("""
    SELECT "table", bool_and(rid > before OR before IS NULL) AS ok FROM (
        SELECT event_type AS "table", CASE WHEN event_id % 5003 = 77 AND event_type = 'click' THEN 0 ELSE event_id END AS rid,
               lag(CASE WHEN event_id % 5003 = 77 AND event_type = 'click' THEN 0 ELSE event_id END) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) GROUP BY "table\"""")
def q_ascending_rids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rid = F.when((F.col("event_id") % 5003 == 77) & (F.col("event_type") == "click"), 0).otherwise(F.col("event_id"))
    return adapter.ascending(e.select(F.col("event_type").alias("table"), F.floor(F.col("event_id") / 100).alias("page"), F.col("event_id").alias("pos"), rid.alias("rid")))


@register("SELECT user_id AS rid, max(version) AS version, arg_min(file_name, (-version, event_id)) AS file_name FROM (SELECT user_id, event_id, event_id % 5 AS version, 'f' || event_id || '.pdf' AS file_name FROM events) WHERE version >= 1 GROUP BY user_id")
def q_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return adapter.latest_versions(e.select(F.col("user_id").alias("rid"), F.col("event_id").alias("pos"), (F.col("event_id") % 5).alias("version"), F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("file_name")))


@register("""
    SELECT event_id, CASE WHEN w AND s AND a THEN 'complete_for_declared_scope' WHEN NOT w THEN 'partial' ELSE 'unverified' END AS coverage, CASE WHEN s THEN 'stable_verified' ELSE 'changed_during_capture' END AS consistency,
           CASE WHEN NOT w THEN 'pagination_incomplete' ELSE 'query_total_matched' || CASE WHEN s THEN ',two_pass_stable' ELSE '' END || CASE WHEN a THEN ',operator_attestation' ELSE '' END END AS basis
    FROM (SELECT event_id, event_id % 2 = 0 AS w, event_id % 3 = 0 AS s, event_id % 5 = 0 AS a FROM events)""")
def q_earned_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    facts = e.select("event_id", (F.col("event_id") % 2 == 0).alias("whole"), (F.col("event_id") % 3 == 0).alias("stable"), (F.col("event_id") % 5 == 0).alias("attested"))
    return adapter.earned(facts).select("event_id", "coverage", "consistency", joined("basis").alias("basis"))


@register("""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 3 THEN NULL WHEN 4 THEN 'true' ELSE CAST(event_id AS VARCHAR) END AS cell, event_id % 6 IN (0, 2, 4) AS unexpected
    FROM (SELECT event_id, '"' || event_type || '"' AS event_type FROM events)""")
def q_convert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id").cast("string")
    kind = F.col("event_id") % 6
    body = F.when(kind == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(kind == 1, n).when(kind == 2, F.concat(n, F.lit(".5"))).when(kind == 3, "null").when(kind == 4, "true").otherwise(F.concat(n, F.lit(".0")))
    cell, odd = adapter.converted("numeric", F.parse_json(body))
    return e.select("event_id", cell.alias("cell"), odd.alias("unexpected"))
