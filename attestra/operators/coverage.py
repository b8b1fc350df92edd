"""R1: is the scope established, and how far each dataset's claim of completeness holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import COMPLETE, COVERAGE_REASONS, COVERED
from .case import Case, Pack
from .integrity import Records, contradicted, contradictions, unattributable, unattributable_in

CLAIMS = "dataset string, coverage string, basis array<string>, consistency string"


def claims(case: Case) -> DataFrame:
    """The four declarations as rows; a dataset that declares nothing has nulls."""
    rows = [(n, *((c.coverage, sorted(c.basis), c.consistency) if (c := case.declared.get(n)) else (None, None, None))) for n in COVERED]
    return case.files.sparkSession.createDataFrame(rows, CLAIMS)


def accepted_basis(pack: Pack) -> F.Column:
    """Whether any accepted set of bases is contained in the row's ``basis``."""
    sets = F.array(*[F.array(*map(F.lit, sorted(b))) for b in pack.accepted_bases])
    return F.exists(sets, lambda one: F.size(F.array_except(one, F.col("basis"))) == 0)


def effective(claimed: DataFrame, wrong: DataFrame, lost: DataFrame, pack: Pack) -> DataFrame:
    """``dataset``, ``coverage``, ``basis``, ``consistency``, ``reasons`` (in order), ``effective``.

    ``wrong`` and ``lost`` (dataset, n) count contradicted references and unattributable rows.
    """
    rows = claimed.join(wrong.withColumnRenamed("n", "wrong"), "dataset", "left").join(lost.withColumnRenamed("n", "lost"), "dataset", "left")
    applies = {
        "DATASET_MISSING": F.col("coverage").isNull(),
        "COVERAGE_PARTIAL": F.col("coverage") == "partial",
        "COVERAGE_UNVERIFIED": F.col("coverage") == "unverified",
        "COVERAGE_BASIS_NOT_ACCEPTED": (F.col("coverage") == COMPLETE) & ~accepted_basis(pack),
        "CHANGED_DURING_CAPTURE": F.col("consistency") == "changed_during_capture",
        "COVERAGE_CONTRADICTED": F.col("wrong") > 0,
        "UNATTRIBUTABLE_RECORDS": F.col("lost") > 0,
    }
    reasons = F.filter(F.array(*[F.when(applies[r], r) for r in COVERAGE_REASONS]), lambda r: r.isNotNull())
    effects = F.create_map(*[F.lit(x) for pair in COVERAGE_REASONS.items() for x in pair])
    first = F.get("reasons", F.lit(0))
    return rows.withColumn("reasons", reasons).select(
        "dataset", "coverage", "basis", "consistency", "reasons", F.coalesce(F.element_at(effects, first), F.lit(COMPLETE)).alias("effective")
    )


def effective_coverage(case: Case, rec: Records, defects: DataFrame | None = None) -> DataFrame:
    """What the claims come to, read off the defects if these are there, else off the records."""
    if defects is not None:
        return effective(claims(case), contradicted(defects), unattributable_in(defects), case.pack)
    rec.rows.together()
    return effective(claims(case), contradictions(case, rec), unattributable(rec), case.pack)


def dataset_findings(coverage: DataFrame) -> DataFrame:
    """Four findings, one for each declaration."""
    observed = F.struct("basis", F.col("coverage").alias("declared"), "consistency", "effective", "reasons")
    ok = F.size("reasons") == 0
    return coverage.select(
        F.lit("R1").alias("check_id"), F.lit("dataset").alias("subject_kind"), F.col("dataset").alias("subject_id"), F.lit(None).cast("string").alias("code_suffix"),
        F.when(ok, "PASS").otherwise("UNKNOWN").alias("outcome"), F.when(ok, "COVERAGE_COMPLETE").otherwise(F.get("reasons", F.lit(0))).alias("reason"),
        F.lit(True).alias("required"), F.lit(f'{{"effective":"{COMPLETE}"}}').alias("expected"), F.to_json(observed, {"ignoreNullFields": "false"}).alias("observed"),
    )


def project_finding(case: Case, rec: Records) -> DataFrame:
    """One finding: the scope is established, or the first reason why it isn't."""
    scope = rec.rows["scope"]
    live = scope.where("NOT quarantined")
    # two bounded facts for each check: is there any row that differs
    facts = live.agg(
        F.bool_or(F.col("scope_revision") != F.lit(case.scope_revision)).alias("other_revision"),
        F.bool_or(F.col("project_id") != F.lit(case.project_id)).alias("other_project"),
    )
    facts = facts.join(F.broadcast(scope.agg(F.bool_or(F.col("row_key").isNull() & F.col("quarantined")).alias("invalid"), F.countDistinct("obligation_id").alias("n"))))
    reason = (
        F.when(~F.lit(case.scope_present), "SCOPE_MISSING").when(F.col("invalid"), "SCOPE_INVALID").when(F.col("n") == 0, "SCOPE_EMPTY")
        .when(~F.lit(case.scope_accepted), "SCOPE_NOT_ACCEPTED")
        .when(F.lit(case.scope_revision != case.pack.scope_revision) | F.col("other_revision"), "SCOPE_REVISION_MISMATCH")
        .when(F.col("other_project"), "SCOPE_PROJECT_MISMATCH").otherwise("SCOPE_ESTABLISHED")
    )
    # the distinct values are found side by side; the finding lists them
    listed = lambda c: F.broadcast(live.select(c).distinct().agg(F.array_sort(F.collect_list(c)).alias(f"row_{c}s")))
    facts = facts.join(listed("project_id")).join(listed("scope_revision"))
    observed = F.struct(
        F.lit(case.scope_accepted).alias("accepted"), F.lit(case.scope_revision).alias("manifest_scope_revision"), F.col("n").alias("obligation_count"),
        "row_project_ids", "row_scope_revisions", F.lit(case.scope_present).alias("scope_present"),
    )
    return facts.withColumn("reason", reason).select(
        F.lit("R1").alias("check_id"), F.lit("project").alias("subject_kind"), F.lit(case.project_id).alias("subject_id"), F.lit(None).cast("string").alias("code_suffix"),
        F.when(F.col("reason") == "SCOPE_ESTABLISHED", "PASS").otherwise("UNKNOWN").alias("outcome"), "reason", F.lit(True).alias("required"),
        F.lit(f'{{"project_id":"{case.pack.project_id}","scope_revision":"{case.pack.scope_revision}"}}').alias("expected"),
        F.to_json(observed, {"ignoreNullFields": "false"}).alias("observed"),
    )
