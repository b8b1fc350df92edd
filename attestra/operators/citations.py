"""The rows that findings cite: one row for each finding, dataset and place, by joins alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import integrity, rules
from .chain import Evaluated


def _of(*checks: str) -> Column:
    """Keys of those of an obligation's findings that were evaluated."""
    keys = [F.when(F.col(f"{c.lower()}_outcome") != "NOT_EVALUATED", F.concat(F.lit(f"{c}:obligation:"), F.col("obligation_id"))) for c in checks]
    return F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("key")


def citations(done: Evaluated) -> DataFrame:
    """``key``, ``dataset``, ``locator``, each once; findings that cite nothing have no row."""
    live = {name: done.records.live(name) for name in done.records.rows}
    judged = done.chain.select("obligation_id", F.col("candidate.inspection_id").alias("inspection_id"), F.col("candidate.revision").alias("revision"), F.col("candidate.i_activity").alias("activity_kind"),
                               *[f"r{k}_outcome" for k in range(2, 7)])
    rows = lambda name, *columns: live[name].select(*columns, "dataset", "locator")
    told = ("key", "dataset", "locator")
    parts = [
        judged.join(rows("scope", "obligation_id"), "obligation_id").select(_of("R2", "R3"), *told[1:]),
        judged.drop("inspection_id", "revision").join(rows("inspections", "obligation_id"), "obligation_id").select(_of("R2"), *told[1:]),
        judged.join(rows("inspections", "inspection_id", "revision"), ["inspection_id", "revision"]).select(_of("R3", "R4", "R5", "R6"), *told[1:]),
    ]
    held = judged.drop("revision").join(live["artifacts"].where("is_current").select("inspection_id", "document_kind", "dataset", "locator"), "inspection_id")
    needed = F.broadcast(rules.required_kinds(done.case.pack, done.case.files.sparkSession))  # as long as the pack
    parts += [held.select(_of("R3"), *told[1:]), held.join(needed, ["activity_kind", "document_kind"], "left_semi").select(_of("R4", "R5"), *told[1:])]
    decided = judged.where("r6_outcome <> 'NOT_EVALUATED'").join(rows("approvals", "inspection_id", "approval_id"), "inspection_id")
    items = decided.select(_of("R6"), "approval_id").join(rows("approval_items", "approval_id"), "approval_id")
    parts += [decided.select(_of("R6"), *told[1:]), items.select(*told)]
    loose = rules.unmatched(live["inspections"], done.records.obligations)
    if done.project.first().outcome == "PASS":
        parts.append(loose.select(F.concat(F.lit("R7:inspection:"), F.col("inspection_id")).alias("key"), *told[1:]))
    parts.append(done.records.rows["scope"].select(F.lit(f"R1:project:{done.case.project_id}").alias("key"), *told[1:]))
    parts.append(integrity.evidence(done.defects).select(*told))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
