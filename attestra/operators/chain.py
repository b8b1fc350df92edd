"""The whole assessment: R0, R1, the chain R2 -> R3 -> (R4, R5) -> R6 of each obligation, and R7."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import CHECKS, COMPLETE
from ..sources.staging import narrowed, staged
from . import coverage, integrity, rules
from .case import Case, RunError
from .findings import duplicate_findings

FINDING = ("check_id", "subject_kind", "subject_id", "code_suffix", "outcome", "reason", "required", "expected", "observed", "blocked_by", "caused_by")
#: Verdicts that only incomplete coverage makes uncertain, and whose it is.
CAUSED_BY = {
    "CARDINALITY_UNCONFIRMED": "inspections", "ABSENCE_UNCONFIRMED": "inspections", "IDENTITY_UNCONFIRMED": "artifacts", "KIND_ABSENCE_UNCONFIRMED": "artifacts",
    "NOT_CAPTURED": "evidence_files", "AVAILABILITY_UNCONFIRMED": "artifacts", "APPROVAL_UNCONFIRMED": "approvals",
}


class Evaluated:
    """The parts of an assessment, each worked out when first asked for and written once, as every later part reads it again.

    ``chain`` has the verdicts of each obligation side by side; ``findings`` all findings.
    """

    def __init__(self, case: Case, detect_duplicates: bool = True):
        self.case, self.detect_duplicates, self.some = case, detect_duplicates, {}

    @cached_property
    def records(self) -> integrity.Records:
        return integrity.records(self.case, self.detect_duplicates)

    @cached_property
    def defects(self) -> DataFrame:
        return staged(integrity.defects(self.case, self.records), "defects")

    def defects_of(self, *codes: str) -> DataFrame:
        """The defects of some codes: if not all are there yet, only these are looked for, in the datasets that may have them."""
        if "defects" in self.__dict__ or not codes:
            return self.defects
        if codes not in self.some:
            self.some[codes] = staged(integrity.defects(self.case, self.records, codes), "defects")
        return self.some[codes]

    @cached_property
    def coverage(self) -> DataFrame:
        defects = self.__dict__.get("defects")  # not made for this alone
        return staged(coverage.effective_coverage(self.case, self.records, defects), "coverage")

    @cached_property
    def project(self) -> DataFrame:
        return staged(coverage.project_finding(self.case, self.records), "project")

    @cached_property
    def complete(self) -> dict[str, bool]:
        """Which declarations hold; four rows."""
        return {r.dataset: r.effective == COMPLETE for r in self.coverage.collect()}

    @cached_property
    def r2(self) -> DataFrame:
        defects, established = self.defects, self.project.first()
        return staged(first_verdicts(self.records, defects, self.complete, established.outcome == "PASS", f"R1:project:{established.subject_id}"), "r2")

    @cached_property
    def candidates(self) -> DataFrame:
        return self.r2.where(IS_SINGLE).select("obligation_id", "o_project", "o_asset", "o_activity", "candidate.*")

    @cached_property
    def artifacts(self) -> DataFrame:
        """The current artifacts of candidates; rules look at no others."""
        return narrowed(self.records.live("artifacts").where("is_current"), self.candidates, "inspection_id")

    @cached_property
    def r3(self) -> DataFrame:
        return staged(rules.identity(self.candidates, self.artifacts, self.complete["artifacts"]), "r3")

    @cached_property
    def evidence(self) -> DataFrame:
        """R4 and R5 of the candidates that R3 doesn't fail, and their evidence digests."""
        case, pack = self.case, self.case.pack
        sound = self.candidates.join(self.r3.where("r3_outcome <> 'FAIL'").select("obligation_id"), "obligation_id", "left_semi")
        kinds = rules.required_kinds(pack, case.files.sparkSession)
        held = rules.required_evidence(sound, self.artifacts, kinds, case.files)
        return staged(rules.evidence_verdicts(sound, held, kinds, self.complete["artifacts"], self.complete["evidence_files"], pack.evidence_scheme or rules.EVIDENCE_SCHEME), "evidence")

    @cached_property
    def chain(self) -> DataFrame:
        return staged(verdicts(self), "chain")

    @cached_property
    def findings(self) -> DataFrame:
        return unique(staged(all_findings(self.case, self), "findings"))

    @cached_property
    def outcomes(self) -> DataFrame:
        """All findings without what they expected and observed, which isn't made for this."""
        if "findings" in self.__dict__:
            return self.findings.drop("expected", "observed")
        return unique(staged(all_findings(self.case, self, shown=False).drop("expected", "observed"), "findings"))

    def findings_of(self, *checks: str) -> DataFrame:
        """The findings of some checks: if not all are there yet, only these are made."""
        if "findings" in self.__dict__:
            return self.findings.where(F.col("check_id").isin(*checks))
        if checks not in self.some:
            self.some[checks] = unique(staged(all_findings(self.case, self, checks), "findings"))
        return self.some[checks]


def unique(found: DataFrame) -> DataFrame:
    """``found``, written findings, of which no two may share a key."""
    if (twice := duplicate_findings(found).first()) is not None:
        raise RunError("ENGINE_DUPLICATE_KEY", f"{twice.n} findings share {twice.key}")
    return found


def evaluate(case: Case, detect_duplicates: bool = True) -> Evaluated:
    case.guard()
    return Evaluated(case, detect_duplicates)


IS_SINGLE = "r2_reason IN ('SINGLE_CURRENT_COMPLETED', 'CARDINALITY_UNCONFIRMED')"


def first_verdicts(rec: integrity.Records, defects: DataFrame, complete: dict[str, bool], established: bool, project_key: str) -> DataFrame:
    """One row for each obligation with r2 (outcome, reason and what blocks it), and its candidate."""
    blocked = integrity.blocking(defects, rec)
    counted = rules.cardinality(rec.live("scope"), rec.live("inspections"))
    base = rec.obligations.join(blocked, "obligation_id", "left").join(
        counted.select("obligation_id", F.col("project_id").alias("o_project"), F.col("asset_id").alias("o_asset"), F.col("activity_kind").alias("o_activity"), "n_current", "n_completed", "n_superseded", "candidate", "current"),
        "obligation_id", "left",
    )
    outcome, reason = rules.r2_verdict(complete["inspections"])
    kept_back = F.lit(not established) | F.col("keys").isNotNull()
    return base.select(
        "obligation_id", "o_project", "o_asset", "o_activity", "n_current", "n_completed", "n_superseded", "candidate", "current",
        F.when(kept_back, "NOT_EVALUATED").otherwise(outcome).alias("r2_outcome"), F.when(kept_back, "BLOCKED_BY_UPSTREAM").otherwise(reason).alias("r2_reason"),
        F.when(F.lit(not established), F.array(F.lit(project_key))).when(F.col("keys").isNotNull(), F.col("keys")).otherwise(F.array().cast("array<string>")).alias("r2_blocked"),
    )


def verdicts(done: Evaluated) -> DataFrame:
    """One row for each obligation with r2 to r6: outcome, reason and what blocks it."""
    case, live, is_single, base, r3, found = done.case, done.records.live, F.expr(IS_SINGLE), done.r2, done.r3, done.evidence
    ready = found.where("r4_outcome = 'PASS' AND r5_outcome = 'PASS'").select("obligation_id", "inspection_id", "revision", "digest", "required_set")
    approvals = narrowed(live("approvals"), ready, "inspection_id")
    classified = rules.classified_approvals(ready, approvals, live("approval_items"), case.pack.binding)
    r6 = rules.approval_verdicts(classified, done.complete["approvals"])
    # only candidates have more verdicts; the other rows stay where they are
    out = base.where(is_single).join(r3, "obligation_id", "left").join(found.drop("inspection_id", "revision"), "obligation_id", "left").join(r6, "obligation_id", "left")
    out = out.unionByName(base.where(~is_single), allowMissingColumns=True)

    def key(check: str) -> Column:
        return F.concat(F.lit(f"{check}:obligation:"), F.col("obligation_id"))

    no_r3, no_r4 = F.col("r3_outcome").isNull(), F.col("r4_outcome").isNull()
    none = F.array().cast("array<string>")
    failed = F.filter(F.array(F.when(F.coalesce("r4_outcome", F.lit("NOT_EVALUATED")) != "PASS", key("R4")), F.when(F.coalesce("r5_outcome", F.lit("NOT_EVALUATED")) != "PASS", key("R5"))), lambda k: k.isNotNull())
    blocks = {
        "r3": F.when(no_r3, F.array(key("R2"))).otherwise(none),
        "r4": F.when(no_r4, F.array(key("R3"))).otherwise(none),
        "r5": F.when(no_r4, F.array(key("R3"))).when(F.col("r5_outcome").isNull(), F.array(key("R4"))).otherwise(none),
        "r6": F.when(F.col("r6_outcome").isNull(), failed).otherwise(none),
    }
    return out.select(
        "obligation_id", "r2_outcome", "r2_reason", "r2_blocked", "n_current", "n_completed", "n_superseded", "candidate",
        *[c for r in ("r3", "r4", "r5", "r6") for c in (
            F.coalesce(f"{r}_outcome", F.lit("NOT_EVALUATED")).alias(f"{r}_outcome"), F.coalesce(f"{r}_reason", F.lit("BLOCKED_BY_UPSTREAM")).alias(f"{r}_reason"), blocks[r].alias(f"{r}_blocked"),
        )],
        "o_project", "o_asset", "o_activity", "current", "r3_observed", "needed", "missing", "witnesses", "files", "n_files", "digest", "required_set",
        "r6_approvals", "r6_revisions", "r6_wrong_digests", "r6_wrong_revisions", F.coalesce("r6_binding", F.lit(case.pack.binding)).alias("r6_binding"),
    )


def obligation_findings(chain: DataFrame, checks: tuple[str, ...] = ("R2", "R3", "R4", "R5", "R6"), shown: bool = True) -> DataFrame:
    """Five findings for each row of ``verdicts``, or those of ``checks``; unless ``shown``, without what they expected and observed (null)."""
    blank = F.lit("{}")
    keep = {"ignoreNullFields": "false"}
    named = lambda **members: F.struct(*[F.col(c).alias(k) for k, c in sorted(members.items())])
    expected = {
        "r2": F.lit('{"current_completed_inspections":1}'), "r3": F.to_json(named(project_id="o_project", asset_id="o_asset", activity_kind="o_activity"), keep),
        "r4": F.to_json(named(document_kinds="needed"), keep), "r5": F.to_json(named(files="n_files")),
        "r6": F.concat(F.lit('{"approved_artifact_revisions":['), F.array_join("r6_wrong_revisions", ","), F.lit('],"approved_evidence_digests":'), F.to_json("r6_wrong_digests"), F.lit("}")),
    }
    # a requirement that isn't defined misses no kind
    lacks = F.struct(F.col("witnesses").alias("kinds"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing_kinds"))
    observed = {
        "r2": F.to_json(named(current_inspections="current", superseded_revisions="n_superseded")), "r3": F.coalesce("r3_observed", blank), "r4": F.to_json(lacks, keep),
        "r5": F.to_json(F.struct("files")),
        "r6": F.to_json(named(
            approved_revisions="r6_revisions", binding="r6_binding", current_artifact_revisions="required_set", current_evidence_digest="digest", decision_approvals="r6_approvals")),
    }
    cause = F.create_map(*[F.lit(x) for k, v in CAUSED_BY.items() for x in (k, f"R1:dataset:{v}")])
    parts = []
    for r in map(str.lower, checks):
        if not shown:
            expected[r] = observed[r] = blank = F.lit(None).cast("string")
        off = F.col(f"{r}_outcome") == "NOT_EVALUATED"
        caused = F.element_at(cause, F.col(f"{r}_reason"))
        parts.append(F.struct(
            F.lit(r.upper()).alias("check_id"), F.lit("obligation").alias("subject_kind"), F.col("obligation_id").alias("subject_id"), F.lit(None).cast("string").alias("code_suffix"),
            F.col(f"{r}_outcome").alias("outcome"), F.col(f"{r}_reason").alias("reason"), F.lit(True).alias("required"),
            F.when(off, blank).otherwise(expected[r]).alias("expected"), F.when(off, blank).otherwise(observed[r]).alias("observed"),
            F.col(f"{r}_blocked").alias("blocked_by"), F.when(caused.isNotNull(), F.array(caused)).otherwise(F.array().cast("array<string>")).alias("caused_by"),
        ))
    return chain.select(F.inline(F.array(*parts)))


def all_findings(case: Case, done: Evaluated, checks: tuple[str, ...] = CHECKS, shown: bool = True) -> DataFrame:
    """Every finding of the assessment (or of R1 and R7 alone), with the columns of ``FINDING``; those of obligations without what they expected and observed unless ``shown``."""
    none = F.array().cast("array<string>")
    spark = case.files.sparkSession
    done.records.rows.together()
    every = set(checks) >= set(CHECKS)
    if every:
        r0 = integrity.findings(done.defects, done.records)
        if done.defects.isEmpty():
            r0 = spark.createDataFrame([("R0", "snapshot", "all", None, "PASS", "INTEGRITY_OK", True, "{}", "{}")], r0.schema)
    r1 = done.project.unionByName(coverage.dataset_findings(done.coverage))
    entities = rules.unmatched_entities(done.records.live("inspections"), done.records.obligations)
    r7 = entities.select(
        F.lit("R7").alias("check_id"), F.lit("inspection").alias("subject_kind"), F.col("inspection_id").alias("subject_id"), F.lit(None).cast("string").alias("code_suffix"),
        F.lit("FAIL").alias("outcome"), F.lit("UNMATCHED_INSPECTION").alias("reason"), F.lit(False).alias("required"), F.lit("{}").alias("expected"),
        F.to_json(F.struct(F.col("revisions").alias("current_revisions"), "obligation_ids"), {"ignoreNullFields": "false"}).alias("observed"),
    )
    project = done.project.first()
    plain = lambda df: df.withColumns({"blocked_by": none, "caused_by": none}).select(*FINDING)
    whole = lambda outcome, reason, blocked: spark.createDataFrame(
        [("R7", "snapshot", "all", None, outcome, reason, False, "{}", "{}", blocked, [])],
        "check_id string, subject_kind string, subject_id string, code_suffix string, outcome string, reason string, required boolean, expected string, observed string, blocked_by array<string>, caused_by array<string>",
    )
    if project.outcome != "PASS":
        last = whole("NOT_EVALUATED", "BLOCKED_BY_UPSTREAM", [f"R1:project:{project.subject_id}"])
    elif entities.isEmpty():
        last = whole("PASS", "NO_UNMATCHED_RECORDS", [])
    else:
        last = plain(r7)
    out = plain(r1).unionByName(last.select(*FINDING))
    if not every:
        return out.where(F.col("check_id").isin(*checks))
    return out.unionByName(plain(r0)).unionByName(obligation_findings(done.chain, shown=shown).select(*FINDING))
