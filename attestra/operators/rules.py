"""R2 to R7 over all obligations at once.

Every rule is a few joins and one group-by on the obligation or the inspection.
Upstream verdicts mask downstream ones with CASE, so a blocked obligation costs
no extra pass. Joins are plain equi-joins on identifiers: Spark chooses their
kind by size and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import narrowed, staged
from .case import Pack

#: The domain tag of evidence digests; part of the digested bytes.
EVIDENCE_SCHEME = "attestra/evidence-set/v1"


def at_revision(id_column: str) -> Column:
    return F.concat_ws("@", id_column, "revision")


def required_kinds(pack: Pack, spark) -> DataFrame:
    """``activity_kind``, ``document_kind``: a row for each document that an activity needs (bounded by the pack)."""
    rows = [(a, d) for a, kinds in sorted(pack.requirements.items()) for d in sorted(kinds)]
    return spark.createDataFrame(rows, "activity_kind string, document_kind string")


# --- R2 -------------------------------------------------------------------------


def cardinality(scope: DataFrame, inspections: DataFrame) -> DataFrame:
    """For each scope row: how many current inspections, how many completed, superseded ones, and the only candidate."""
    linked = inspections.where("obligation_id IS NOT NULL")
    # lists and structs are made by a sort: of current rows alone, as the others are only counted
    now = linked.where("is_current").groupBy("obligation_id").agg(
        F.count("*").alias("n_current"),
        F.count_if(F.col("completion_status") == "completed").alias("n_completed"),
        F.array_sort(F.collect_list(at_revision("inspection_id"))).alias("current"),
        F.max(F.struct("inspection_id", "revision", F.col("project_id").alias("i_project"), F.col("asset_id").alias("i_asset"), F.col("activity_kind").alias("i_activity"), "completion_status")).alias("candidate"),
    )
    past = linked.where("NOT is_current").groupBy("obligation_id").agg(F.count("*").alias("n_superseded"))
    zero = {"n_current": 0, "n_completed": 0, "n_superseded": 0}
    out = scope.join(now, "obligation_id", "left").join(past, "obligation_id", "left").fillna(zero)
    return out.withColumn("current", F.coalesce("current", F.array().cast("array<string>")))


def r2_verdict(complete: bool) -> tuple[Column, Column]:
    """Outcome and reason from the counts; absence and uniqueness only hold where coverage is complete."""
    n, done, whole = F.col("n_current"), F.col("n_completed"), F.lit(complete)
    reason = (
        F.when(n >= 2, "MULTIPLE_CURRENT").when((n == 1) & (done == 0), "NOT_COMPLETED")
        .when((n == 1) & whole, "SINGLE_CURRENT_COMPLETED").when(n == 1, "CARDINALITY_UNCONFIRMED")
        .when(whole, "NO_CURRENT_INSPECTION").otherwise("ABSENCE_UNCONFIRMED")
    )
    outcome = F.when(reason == "SINGLE_CURRENT_COMPLETED", "PASS").when(reason.endswith("UNCONFIRMED"), "UNKNOWN").otherwise("FAIL")
    return outcome, reason


def single_candidates(scope: DataFrame, inspections: DataFrame) -> DataFrame:
    """Obligations with exactly one current inspection, and that inspection (``i_*`` its own identity columns)."""
    found = cardinality(scope, inspections).where("n_current = 1")
    return found.select(
        "obligation_id", F.col("project_id").alias("o_project"), F.col("asset_id").alias("o_asset"), F.col("activity_kind").alias("o_activity"), "candidate.*"
    )


# --- R3 -------------------------------------------------------------------------


def mismatches(candidates: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``obligation_id``, ``rank`` (of the reason), ``subject``, ``subject_id``, ``field``, ``expected``, ``observed``."""
    def pairs(subject: str, ident: str, fields: list[tuple[int, str, str, str]]) -> Column:
        return F.array(*[
            F.struct(F.lit(rank).alias("rank"), F.lit(subject).alias("subject"), F.col(ident).alias("subject_id"), at_revision(ident).alias("named"),
                     F.lit(name).alias("field"), F.col(want).alias("expected"), F.col(got).alias("observed"))
            for rank, name, want, got in fields
        ])

    own = candidates.select("obligation_id", F.inline(pairs("inspection", "inspection_id", [
        (0, "project_id", "o_project", "i_project"), (1, "asset_id", "o_asset", "i_asset"), (2, "activity_kind", "o_activity", "i_activity")])))
    held = candidates.select("obligation_id", "inspection_id", "o_project", "o_asset").join(
        artifacts.where("is_current").select("inspection_id", "artifact_id", "revision", "project_id", "asset_id"), "inspection_id"
    )
    held = held.select("obligation_id", F.inline(pairs("artifact", "artifact_id", [(3, "project_id", "o_project", "project_id"), (4, "asset_id", "o_asset", "asset_id")])))
    return own.unionByName(held).where("observed <> expected")


R3_REASONS = ("INSPECTION_PROJECT_MISMATCH", "INSPECTION_ASSET_MISMATCH", "INSPECTION_ACTIVITY_MISMATCH", "ARTIFACT_PROJECT_MISMATCH", "ARTIFACT_ASSET_MISMATCH")


def identity(candidates: DataFrame, artifacts: DataFrame, complete: bool) -> DataFrame:
    """``obligation_id``, ``r3_outcome``, ``r3_reason``, ``r3_observed`` of each candidate."""
    wrong = mismatches(candidates, artifacts).groupBy("obligation_id").agg(
        F.min("rank").alias("rank"),
        F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "subject", "named").alias("subject"), "field", "expected", "observed"))).alias("list"),
    )
    out = candidates.select("obligation_id").join(wrong, "obligation_id", "left")
    shown = F.transform(F.coalesce("list", F.array().cast("array<struct<subject:string,field:string,expected:string,observed:string>>")),
                        lambda m: F.struct(m.expected.alias("expected"), m.field.alias("field"), m.observed.alias("observed"), m.subject.alias("subject")))
    reasons = F.array(*map(F.lit, R3_REASONS))
    return out.select(
        "obligation_id", F.when(F.col("rank").isNotNull(), "FAIL").otherwise("PASS" if complete else "UNKNOWN").alias("r3_outcome"),
        F.coalesce(F.get(reasons, "rank"), F.lit("IDENTITY_CONSISTENT" if complete else "IDENTITY_UNCONFIRMED")).alias("r3_reason"),
        F.to_json(F.struct(shown.alias("mismatches"))).alias("r3_observed"),
    )


# --- R4, R5 and the digest: one pass over the evidence of each candidate ----------


def missing_kinds(candidates: DataFrame, artifacts: DataFrame, kinds: DataFrame) -> DataFrame:
    """``obligation_id``, ``missing_kind``: required kinds of which a completed candidate has no current artifact."""
    need = candidates.where("completion_status = 'completed'").select("obligation_id", "inspection_id", F.col("i_activity").alias("activity_kind"))
    need = need.join(F.broadcast(kinds), "activity_kind")
    have = artifacts.where("is_current").select("inspection_id", "document_kind")
    return need.join(have, ["inspection_id", "document_kind"], "left_anti").select("obligation_id", F.col("document_kind").alias("missing_kind"))


def digest_of(entries: Column, scheme: str = EVIDENCE_SCHEME) -> Column:
    """Content address of an evidence set: canonical JSON of its sorted entries, hashed.

    ``entries`` are structs (document_kind, artifact_id, revision, sha256), in any
    order. Grammars keep their strings free of anything that JSON escapes.
    """
    ordered = F.transform(F.array_sort(entries), lambda e: F.struct(e.artifact_id.alias("artifact_id"), e.document_kind.alias("document_kind"), e.revision.alias("revision"), e.sha256.alias("sha256")))
    text = F.to_json(F.struct(ordered.alias("artifacts"), F.lit(scheme).alias("scheme")))
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def required_evidence(candidates: DataFrame, artifacts: DataFrame, kinds: DataFrame, files: DataFrame) -> DataFrame:
    """Current artifacts of required kinds of each candidate, with their files' status (``no_path`` without a path)."""
    held = candidates.select("obligation_id", "inspection_id", F.col("i_activity").alias("activity_kind")).join(
        artifacts.where("is_current").select("inspection_id", "artifact_id", "revision", "document_kind", "relative_path"), "inspection_id"
    )
    held = held.join(F.broadcast(kinds), ["activity_kind", "document_kind"], "left_semi")
    # only some of the files are asked for
    held = staged(held, "held")
    probed = held.join(narrowed(files, held, "relative_path"), "relative_path", "left")
    status = F.when(F.col("relative_path").isNull(), "no_path").otherwise(F.coalesce("status", F.lit("absent")))
    return probed.select("obligation_id", "inspection_id", "artifact_id", "revision", "document_kind", "relative_path", status.alias("status"), "sha256")


def evidence_verdicts(
    candidates: DataFrame, evidence: DataFrame, kinds: DataFrame, artifacts_complete: bool, files_complete: bool, scheme: str = EVIDENCE_SCHEME
) -> DataFrame:
    """R4 and R5 of each candidate, its evidence digest and its set of required revisions."""
    needs = kinds.groupBy("activity_kind").agg(F.array_sort(F.collect_set("document_kind")).alias("needed"))
    away = F.col("status").isin("absent", "no_path")
    grouped = evidence.groupBy("obligation_id").agg(
        F.count("*").alias("n_files"), F.array_sort(F.collect_set("document_kind")).alias("witnessed"),
        F.count_if(away).alias("n_away"), F.count_if(F.col("status") == "unreadable").alias("n_unreadable"), F.count_if(F.col("status") == "too_large").alias("n_too_large"),
        F.collect_list(F.struct("document_kind", "artifact_id", "revision", "sha256")).alias("entries"),
        F.array_sort(F.collect_list(F.struct(F.concat_ws("@", "artifact_id", "revision").alias("artifact"), "sha256", "status"))).alias("files"),
        F.array_sort(F.collect_set(F.struct("artifact_id", "revision"))).alias("required_set"),
    )
    out = candidates.select("obligation_id", "inspection_id", "revision", F.col("i_activity").alias("activity_kind"))
    out = out.join(F.broadcast(needs), "activity_kind", "left").join(grouped, "obligation_id", "left").fillna({"n_files": 0})
    missing = F.array_except("needed", F.coalesce("witnessed", F.array().cast("array<string>")))
    of_kind = lambda k: F.array_sort(F.transform(F.filter("entries", lambda e: e.document_kind == k), lambda e: e.artifact_id))
    witnesses = F.map_from_entries(F.transform(F.coalesce("witnessed", F.array().cast("array<string>")), lambda k: F.struct(k, of_kind(k))))
    r4 = (
        F.when(F.col("needed").isNull(), "REQUIREMENT_UNDEFINED").when(F.size(missing) == 0, "REQUIRED_KINDS_PRESENT")
        .otherwise("KIND_MISSING" if artifacts_complete else "KIND_ABSENCE_UNCONFIRMED")
    )
    r5 = (
        F.when(F.col("n_files") == 0, None)
        .when(F.col("n_away") > 0, "FILE_ABSENT" if files_complete else "NOT_CAPTURED")
        .when(F.col("n_unreadable") > 0, "FILE_UNREADABLE").when(F.col("n_too_large") > 0, "FILE_TOO_LARGE")
        .otherwise("EVIDENCE_AVAILABLE" if artifacts_complete else "AVAILABILITY_UNCONFIRMED")
    )
    return out.select(
        "obligation_id", "inspection_id", "revision", "n_files", "required_set", "needed", missing.alias("missing"), "files",
        r4.alias("r4_reason"), F.when(r4 == "REQUIRED_KINDS_PRESENT", "PASS").when(r4 == "KIND_MISSING", "FAIL").otherwise("UNKNOWN").alias("r4_outcome"),
        r5.alias("r5_reason"), F.when(r5 == "EVIDENCE_AVAILABLE", "PASS").when(r5 == "FILE_ABSENT", "FAIL").when(r5.isNotNull(), "UNKNOWN").alias("r5_outcome"),
        F.when(r5 == "EVIDENCE_AVAILABLE", digest_of(F.col("entries"), scheme)).alias("digest"), witnesses.alias("witnesses"),
    )


# --- R6 -------------------------------------------------------------------------


def classified_approvals(ready: DataFrame, approvals: DataFrame, items: DataFrame, binding: str) -> DataFrame:
    """Approvals of each ready obligation with ``class`` (MATCH, MISMATCH, or why it can't be told), null for another revision.

    ``ready`` has ``obligation_id``, ``inspection_id``, ``revision``, ``digest``, ``required_set``.
    """
    claimed = ready.join(approvals.select("approval_id", "inspection_id", "inspection_revision", "evidence_digest", "decision", "decided_at"), "inspection_id", "left")
    out = claimed
    if binding == "revisions":
        # the items of an approval that belong to the required artifacts, as a set
        bound = items.groupBy("approval_id").agg(F.array_sort(F.collect_set(F.struct("artifact_id", F.col("artifact_revision").alias("revision")))).alias("listed"))
        ids = F.transform("required_set", lambda r: r.artifact_id)
        mine = F.filter("listed", lambda i: F.array_contains(ids, i.artifact_id))
        out = claimed.join(bound, "approval_id", "left").withColumn("mine", F.to_json(mine)).withColumn("by_items", F.when(F.col("listed").isNotNull(), F.when(mine == F.col("required_set"), "MATCH").otherwise("MISMATCH")))
    else:
        held = items.select("approval_id", F.lit("BINDING_STRENGTH_INSUFFICIENT").alias("by_items")).distinct()
        out = claimed.join(held, "approval_id", "left").withColumn("mine", F.lit(None).cast("string"))
    kind = F.when(F.col("evidence_digest").isNotNull(), F.when(F.col("evidence_digest") == F.col("digest"), "MATCH").otherwise("MISMATCH"))
    kind = F.coalesce(kind, F.col("by_items"), F.lit("BINDING_UNAVAILABLE"))
    return out.withColumn("class", F.when(F.col("inspection_revision") == F.col("revision"), kind))


def approval_verdicts(classified: DataFrame, complete: bool) -> DataFrame:
    """``obligation_id``, ``r6_outcome``, ``r6_reason``, ``r6_approvals`` (those that decide), and what the finding shows of the others."""
    matched = F.col("class") == "MATCH"
    # the latest match first, as later doubts are measured against it; the window leaves rows where the grouping wants them
    rows = classified.withColumn("latest", F.max(F.when(matched, F.col("decided_at"))).over(Window.partitionBy("obligation_id")))
    doubt = F.col("class").startswith("BINDING")
    order = F.struct("decided_at", "approval_id")
    decides = matched & (F.col("decided_at") == F.col("latest"))
    later = doubt & (F.col("latest").isNull() | (F.col("decided_at") > F.col("latest")))
    grouped = rows.groupBy("obligation_id").agg(
        F.count("approval_id").alias("n"), F.count("class").alias("n_current"), F.max("latest").alias("latest"),
        F.min_by(F.when(later, F.struct("class", "approval_id")), F.when(later, order)).alias("doubt"),
        F.array_sort(F.collect_set(F.when(decides, F.col("decision")))).alias("decisions"),
        F.array_sort(F.collect_set(F.when(decides, F.col("approval_id")))).alias("deciding"),
        F.array_sort(F.collect_set(F.when(F.col("class") == "MISMATCH", F.col("approval_id")))).alias("stale"),
        F.array_sort(F.collect_set("inspection_revision")).alias("revisions"),
        F.array_sort(F.collect_set(F.when(~doubt, F.when(F.col("evidence_digest").isNotNull(), "digest").otherwise("revisions")))).alias("bindings"),
        F.array_sort(F.collect_set(F.when(F.col("class") == "MISMATCH", F.col("evidence_digest")))).alias("wrong_digests"),
        F.array_sort(F.collect_set(F.when((F.col("class") == "MISMATCH") & F.col("evidence_digest").isNull(), F.col("mine")))).alias("wrong_revisions"),
    )
    decision = F.get("decisions", F.lit(0))
    reason = (
        F.when(~F.lit(complete), "APPROVAL_UNCONFIRMED").when(F.col("n") == 0, "NO_APPROVAL").when(F.col("n_current") == 0, "REVISION_NOT_APPROVED")
        .when(F.col("doubt").isNotNull(), F.col("doubt.class")).when(F.col("latest").isNull(), "EVIDENCE_CHANGED_SINCE_APPROVAL")
        .when(F.size("decisions") > 1, "CONFLICTING_DECISIONS").when(decision == "approved", "APPROVAL_COVERS_CURRENT")
        .when(decision == "rejected", "APPROVAL_REJECTED").otherwise("APPROVAL_REVOKED")
    )
    unsure = reason.isin("APPROVAL_UNCONFIRMED", "CONFLICTING_DECISIONS", "BINDING_STRENGTH_INSUFFICIENT", "BINDING_UNAVAILABLE")
    named = (
        F.when(reason.startswith("BINDING"), F.array("doubt.approval_id")).when(reason == "EVIDENCE_CHANGED_SINCE_APPROVAL", F.col("stale"))
        .when(reason.isin("APPROVAL_UNCONFIRMED", "NO_APPROVAL", "REVISION_NOT_APPROVED"), F.array().cast("array<string>")).otherwise(F.col("deciding"))
    )
    outcome = F.when(unsure, "UNKNOWN").when(reason == "APPROVAL_COVERS_CURRENT", "PASS").otherwise("FAIL")
    none = F.array().cast("array<string>")
    early = reason.isin("APPROVAL_UNCONFIRMED", "NO_APPROVAL", "REVISION_NOT_APPROVED")
    changed = reason == "EVIDENCE_CHANGED_SINCE_APPROVAL"
    # null: the pack's own binding
    shown = F.when(early | (F.size("bindings") == 0), F.lit(None).cast("string")).when(F.size("bindings") == 1, F.get("bindings", F.lit(0))).otherwise("mixed")
    return grouped.select(
        "obligation_id", outcome.alias("r6_outcome"), reason.alias("r6_reason"), named.alias("r6_approvals"), shown.alias("r6_binding"),
        F.when(reason == "REVISION_NOT_APPROVED", F.col("revisions")).alias("r6_revisions"),
        F.when(changed, F.col("wrong_digests")).otherwise(none).alias("r6_wrong_digests"), F.when(changed, F.col("wrong_revisions")).otherwise(none).alias("r6_wrong_revisions"),
    )


# --- R7 -------------------------------------------------------------------------


def unmatched(inspections: DataFrame, obligations: DataFrame) -> DataFrame:
    """Current inspections that belong to no obligation of the scope; a null link belongs to none.

    An anti-join keeps null keys, which ``NOT IN`` would need a nested loop for.
    """
    return inspections.where("is_current").join(obligations.select("obligation_id"), "obligation_id", "left_anti")


def unmatched_entities(inspections: DataFrame, obligations: DataFrame) -> DataFrame:
    """``inspection_id``, ``revisions``, ``obligation_ids`` (sorted, null last) of unmatched inspections."""
    found = unmatched(inspections, obligations).groupBy("inspection_id")
    return found.agg(
        F.array_sort(F.collect_list("revision")).alias("revisions"),
        F.concat(F.array_sort(F.collect_set("obligation_id")), F.when(F.count_if(F.col("obligation_id").isNull()) > 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))).alias("obligation_ids"),
    )
