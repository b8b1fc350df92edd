"""What is read off the findings: keys, order, counts, roots, status, blocking, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..functions.schema import CHECKS, OUTCOMES, SUBJECTS
from ..sources.staging import few_or_many, staged
from .integrity import finding_key, twice

COMPARED = ("outcome", "reason", "required", "expected", "observed", "blocked_by", "caused_by")


def keyed(findings: DataFrame) -> DataFrame:
    return findings.withColumn("key", finding_key(F.col("check_id"), F.col("subject_kind"), F.col("subject_id"), F.col("code_suffix")))


def duplicate_findings(findings: DataFrame) -> DataFrame:
    """``key``, ``n`` of keys that several findings share; a sound assessment has none.

    Keys themselves are compared only of findings whose key's hash repeats; few share theirs by chance.
    """
    rows = keyed(findings).select("key").withColumn("h", F.shiftrightunsigned(F.xxhash64("key"), 19))
    again = rows.join(few_or_many(staged(twice(rows.select("h")), "repeated")), "h", "left_semi")
    return again.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def rank_columns() -> list[Column]:
    """The order of findings: check, kind of subject, subject, code."""
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    return [place(CHECKS, "check_id"), place(SUBJECTS, "subject_kind"), F.col("subject_id"), F.coalesce("code_suffix", F.lit(""))]


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*rank_columns())


def numbered(findings: DataFrame) -> DataFrame:
    """``key``, ``place``: where each finding stands in the order, from 1.

    Rows go to ranges of the order; a place is the row's number in its range and the
    count of the ranges before, of which there are as many as partitions.
    """
    columns = [c.alias(f"by{k}") for k, c in enumerate(rank_columns())]
    by = [f"by{k}" for k in range(len(columns))]
    ranged = keyed(findings).select("key", *columns).repartitionByRange(*by).sortWithinPartitions(*by)
    # the id holds the partition above bit 33 and the row's number below
    ranged = staged(ranged.select("key", F.monotonically_increasing_id().alias("id")), "findings-order")
    rows = ranged.select("key", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("at"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    return rows.join(F.broadcast(start), "part").select("key", (F.col("at") + F.col("before") + 1).alias("place"))


#: Members of a finding in a document, by name.
MEMBERS = ("blocked_by", "caused_by", "check_id", "expected", "key", "observed", "outcome", "reason", "required", "subject_id", "subject_kind")


def as_json(findings: DataFrame, members: tuple[str, ...] = MEMBERS) -> DataFrame:
    """``json``, canonical text of each finding, beside the columns ``by0`` to ``by3`` of the order; ``expected`` and ``observed`` are JSON already."""
    keep = {"ignoreNullFields": "false"}
    # an element of its own array, so that a string is quoted and a null is written
    text = lambda n: canonical_json(F.parse_json(n)) if n in ("expected", "observed") else F.regexp_replace(F.to_json(F.array(n), keep), r"^\[|\]$", "")
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), text(n)) for n in sorted(members)]), F.lit("}"))
    return keyed(findings).select(*[c.alias(f"by{k}") for k, c in enumerate(rank_columns())], body.alias("json"))


def roots(findings: DataFrame) -> DataFrame:
    """Required findings that failed or can't be told, and that no coverage caused."""
    return findings.where("required AND outcome IN ('FAIL', 'UNKNOWN') AND size(caused_by) = 0")


def counts(findings: DataFrame) -> DataFrame:
    """``tally`` (by_outcome, required, advisory, roots), ``outcome``, ``n``; all outcomes are listed."""
    root = F.col("required") & F.col("outcome").isin("FAIL", "UNKNOWN") & (F.size("caused_by") == 0)
    sums = findings.groupBy("outcome").agg(
        F.count("*").alias("by_outcome"), F.count_if("required").alias("required"), F.count_if(~F.col("required")).alias("advisory"), F.count_if(root).alias("roots")
    )
    every = findings.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    wide = every.join(sums, "outcome", "left").fillna(0)
    long = wide.select("outcome", F.expr("stack(4, 'by_outcome', by_outcome, 'required', required, 'advisory', advisory, 'roots', roots) AS (tally, n)"))
    return long.where("tally <> 'roots' OR outcome IN ('FAIL', 'UNKNOWN')")


def status(findings: DataFrame) -> DataFrame:
    """One row, ``status``: BLOCKED, UNKNOWN or READY_FOR_REVIEW."""
    must = findings.where("required")
    facts = must.agg(F.bool_or(F.col("outcome") == "FAIL").alias("fail"), F.bool_or(F.col("outcome").isin("UNKNOWN", "NOT_EVALUATED")).alias("unsure"))
    return facts.select(F.when(F.col("fail"), "BLOCKED").when(F.col("unsure"), "UNKNOWN").otherwise("READY_FOR_REVIEW").alias("status"))


EXIT_CODES = {"READY_FOR_REVIEW": 0, "BLOCKED": 10, "UNKNOWN": 11}


def blocks(findings: DataFrame, depth: int = len(CHECKS) - 1) -> DataFrame:
    """``key``, ``n``: how many findings each finding blocks, directly or through others.

    A finding is blocked by findings of earlier checks alone, so the number of checks
    bounds a path's length and the closure is a fixed number of joins; paths are made
    distinct after each.
    """
    edges = keyed(findings).select("key", F.explode("blocked_by").alias("by"))
    reach = step = edges.select(F.col("by").alias("top"), F.col("key").alias("below"))
    for _ in range(depth - 1):
        step = step.join(edges, step.below == edges.by).select("top", F.col("key").alias("below")).distinct()
        reach = reach.unionByName(step)
    found = reach.groupBy("top").agg(F.countDistinct("below").alias("n"))
    return keyed(findings).select("key").join(found, F.col("key") == F.col("top"), "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def grid(findings: DataFrame) -> DataFrame:
    """One row for each obligation with the outcomes of R2 to R6 side by side."""
    return findings.where("subject_kind = 'obligation'").groupBy("subject_id").pivot("check_id", ["R2", "R3", "R4", "R5", "R6"]).agg(F.first("outcome"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """``key``, ``change`` (added, removed, changed, unchanged) of two runs' findings."""
    old = keyed(before).select(F.col("key"), F.struct(*COMPARED).alias("old"))
    new = keyed(after).select(F.col("key"), F.struct(*COMPARED).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return old.join(new, "key", "full_outer").select("key", change.alias("change"), "old", "new")


def first_and_more(first: Column, n: Column) -> Column:
    """The first of ``n`` things by order, and how many more there are; both come from pre-aggregated sums."""
    return F.when(n > 1, F.concat(first, F.lit(" (and "), (n - 1).cast("string"), F.lit(" more)"))).otherwise(first)
