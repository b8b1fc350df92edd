"""R0, input integrity: every record defect as a finding, and the obligations it concerns.

All steps are joins and group-bys over the validated rows. ``Records`` keeps the
validated datasets with their quarantine codes; duplicates are found by a group
count joined back, so a key that fills a third of a dataset is one row of counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import DATASETS
from ..sources.staging import few_or_many, narrowed, staged, staged_together
from .case import Case
from .validation import VIOLATIONS, cells_json, place, validated

CELL_CODES = ("INVALID_VALUE", "UNMAPPED_VALUE", "INVALID_PATH")
FAILING = ("DUPLICATE_KEY", "MULTIPLE_CURRENT_REVISIONS", "COMPLETED_WITHOUT_TIMESTAMP")
DEFECT = "dataset string, kind string, subject string, code string, locator string, detail string, via string, via_id string, unattributable boolean"


class Rows(Mapping):
    """Validated rows by dataset, written when first asked for; ``together`` writes those of several side by side."""

    def __init__(self, make: Callable[[list[str]], tuple[dict[str, DataFrame], DataFrame]]):
        self.make, self.made, self.repeated = make, {}, []

    def together(self, names: Iterable[str] = DATASETS) -> None:
        if due := [n for n in names if n not in self.made]:
            rows, repeated = self.make(due)
            self.made |= rows
            self.repeated.append(repeated)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in DATASETS:
            raise KeyError(name)
        self.together([name])
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        self.together()
        return iter(DATASETS)

    def __len__(self) -> int:
        return len(DATASETS)


@dataclass(frozen=True)
class Records:
    """Validated rows by dataset; ``quarantined`` rows take no part in the rules."""

    rows: Rows

    @property
    def repeated(self) -> DataFrame:
        """``dataset``, ``subject``, ``copies``, ``identical`` of keys that stand in two rows or more."""
        self.rows.together()
        return _together(self.rows.repeated)

    def live(self, dataset: str) -> DataFrame:
        return self.rows[dataset].where(~F.col("quarantined"))

    @property
    def obligations(self) -> DataFrame:
        """Every readable obligation id of the scope, of quarantined rows too."""
        return self.rows["scope"].where("row_key IS NOT NULL").select(F.col("obligation_id")).distinct()


def _hash(dataset: str) -> Column:
    """A hash of the cells of the row's key of 45 bits, the last three of them the dataset's number; among a billion keys, some hundred thousand share theirs by chance."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(dataset), *DATASETS[dataset].key), 19).bitwiseAND(F.lit(-8)).bitwiseOR(F.lit(_number(dataset)))


#: Hashes that a task sorts at once.
SORTED = 1 << 20


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes as one list of the lower 32 bits for each bucket (the upper 13 bits); of a hash that repeats, two."""

    def made(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h = np.repeat(h, np.minimum(n, 2))
        bucket = (h >> 32).astype(np.int32)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)).astype(np.int32)), pa.array(h.astype(np.uint32).view(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), lists], ["bucket", "low"])

    held, n = [], 0
    for b in batches:
        held, n = [*held, b.column(0).to_numpy(zero_copy_only=False)], n + b.num_rows
        if n >= SORTED:
            yield made(held)
            held, n = [], 0
    if n:
        yield made(held)


def _again(lists: pa.Table) -> pa.Table:
    """Hashes that stand twice or more in the lists of one bucket."""
    bucket = lists.column("bucket")[0].as_py()
    low, n = np.unique(np.concatenate([c.flatten().to_numpy() for c in lists.column("low").chunks]), return_counts=True)
    return pa.table({"h": (np.int64(bucket) << 32) + low[n > 1].view(np.uint32).astype(np.int64)})


def twice(hashes: DataFrame) -> DataFrame:
    """``h`` of ``hashes`` that stand there twice or more; four bytes a hash are shuffled, and few of one that fills a dataset.

    A bucket's hashes (one in 8,192) are sorted as one array of four bytes each; a row for each in a grouping would
    take some hundred bytes and spill.
    """
    return hashes.mapInArrow(_lists, "bucket int, low array<int>").groupBy("bucket").applyInArrow(_again, "h long")


def _number(dataset: str) -> int:
    return list(DATASETS).index(dataset)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated_keys(raw: dict[str, DataFrame], unmapped: DataFrame | None = None) -> DataFrame:
    """``dataset``, ``subject``, ``copies``, ``identical`` of keys that stand in two rows or more.

    Hashes of keys are counted first, four bytes a row; keys and cells themselves are compared only of rows whose
    hash repeats, so that no other row is shuffled. A sound key is its cells as they are, so only rows whose hash repeats
    are validated for it.
    """
    keyed = {name: rows.withColumn("h", _hash(name)) for name, rows in raw.items()}
    met = staged(twice(_together([rows.select("h") for rows in keyed.values()])), "repeated")
    # each dataset meets its own hashes, which are fewer
    of = {name: few_or_many(met.where(F.col("h").bitwiseAND(7) == _number(name))) for name in keyed}
    again = [validated(rows.join(of[name], "h", "left_semi").drop("h"), name, unmapped) for name, rows in keyed.items()]
    again = _together([rows.select("dataset", "subject", F.sha2(cells_json(name), 256).alias("cells"), "row_key") for name, rows in zip(keyed, again, strict=True)])
    # keys that can't be read are left out after the grouping: before it, the condition would be tested on all rows below the join
    found = again.groupBy("dataset", "subject").agg(F.count("*").alias("copies"), (F.min("cells") == F.max("cells")).alias("identical"), F.bool_or(F.col("row_key").isNotNull()).alias("keyed"))
    return staged(found.where("copies > 1 AND keyed").drop("keyed"), "repeated")


#: Columns of the written records beside the typed values; all others are read off these.
HELD = ("keyed", "link_readable", "malformed", "locator", "file", "row_number", "copies", "identical", "quarantined", "odd")


def records(case: Case, detect_duplicates: bool = True) -> Records:
    """The validated datasets, each written once, when it is asked for, with what is known of repeated keys.

    Only typed values and places are written of sound rows; what else a row needs (raw cells, violations) is
    written of quarantined rows alone, and keys and names are made of the values on reading.
    """
    spark = case.files.sparkSession

    def make(names: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
        raw = {}
        for name in names:
            raw[name] = case.raw.get(name)
            if raw[name] is None:
                raw[name] = spark.createDataFrame([], ", ".join(f"{f.name} string" for f in DATASETS[name].fields) + ", file string, row_number long")
        repeated = repeated_keys(raw, case.unmapped) if detect_duplicates else spark.createDataFrame([], "dataset string, subject string, copies long, identical boolean")
        valid = {name: validated(rows, name, case.unmapped) for name, rows in raw.items()}
        out = {name: packed(rows.join(few_or_many(repeated.where(F.col("dataset") == name).drop("dataset")), "subject", "left"), name) for name, rows in valid.items()}
        return {name: unpacked(rows, name) for name, rows in staged_together(out, "records-").items()}, repeated

    return Records(Rows(make))


def packed(rows: DataFrame, name: str) -> DataFrame:
    """Validated rows as they are written: typed values, ``HELD``."""
    bad = F.col("malformed") | (F.size("violations") > 0) | F.col("copies").isNotNull()
    odd = F.struct("raw", "violations", "raw_cells", "header_count", F.when(F.col("row_key").isNull(), unattributable_id(name)).alias("named"))
    told = rows.withColumns({"keyed": F.col("row_key").isNotNull(), "quarantined": bad}).withColumn("odd", F.when(F.col("quarantined"), odd))
    # a place that is no cell of the row is made of its parts
    return told.withColumn("locator", F.when(~F.col("locator").eqNullSafe(place()), F.col("locator"))).select(*[f.name for f in DATASETS[name].fields], *HELD)


def unpacked(rows: DataFrame, name: str) -> DataFrame:
    """The columns of ``validated`` and ``copies``, ``identical``, ``quarantined``, ``named``, ``kind`` of written records."""
    spec = DATASETS[name]
    subject = F.when(F.col("keyed"), F.concat_ws(spec.between, *spec.key))
    none = F.array().cast(VIOLATIONS)
    return rows.select(
        *[f.name for f in spec.fields], F.col("odd.raw").alias("raw"), F.coalesce("odd.violations", none).alias("violations"), F.when(F.col("keyed"), F.array(*spec.key)).alias("row_key"),
        subject.alias("subject"), "link_readable", "malformed", F.col("odd.raw_cells").alias("raw_cells"), F.col("odd.header_count").alias("header_count"),
        F.coalesce("locator", place()).alias("locator"), F.lit(name).alias("dataset"), "copies", "identical", "quarantined",
        F.coalesce(subject, "odd.named").alias("named"), F.when(F.col("keyed"), spec.subject).otherwise("unattributable_row").alias("kind"),
    )


# --- which obligations a row concerns ----------------------------------------


def entities(rec: Records) -> DataFrame:
    """``inspection_id``, ``obligation_id``: every readable link of an inspection, whatever its revision; not distinct."""
    return rec.rows["inspections"].where("inspection_id IS NOT NULL AND obligation_id IS NOT NULL").select("inspection_id", "obligation_id")


def lost_approvals(rec: Records) -> DataFrame:
    """``approval_id`` of approvals of which some row has an unreadable link."""
    return rec.rows["approvals"].where("row_key IS NOT NULL AND (NOT link_readable OR inspection_id IS NULL)").select("approval_id").distinct()


#: The link of a dataset's rows, and its column.
VIA = {
    "scope": ("obligation", "obligation_id"), "inspections": ("obligation", "obligation_id"), "artifacts": ("inspection", "inspection_id"),
    "approvals": ("inspection", "inspection_id"), "approval_items": ("approval", "approval_id"),
}


def placed(rec: Records, dataset: str) -> DataFrame:
    """The rows of a dataset with ``via`` and ``via_id`` (the obligation, inspection or approval by which they concern obligations) and ``unattributable``.

    A row keeps its one link; obligations are looked up for defects alone, as pairs, so that an
    inspection of very many obligations is no long list in each of its rows.
    """
    rows = rec.rows[dataset]
    readable = F.col("row_key").isNotNull() & F.col("link_readable")
    via, column = VIA[dataset]
    if dataset == "scope":
        readable = F.col("row_key").isNotNull()
    lost = ~readable
    if dataset == "approval_items":
        rows = rows.join(lost_approvals(rec).withColumn("__lost", F.lit(True)), "approval_id", "left")
        lost |= F.coalesce("__lost", F.lit(False))
    there = readable & F.col(column).isNotNull()
    out = rows.withColumns({"via": F.when(there, via), "via_id": F.when(there, F.col(column)), "unattributable": lost})
    return out.drop("__lost")


def reached(rec: Records, links: DataFrame, columns: list[str], few: DataFrame | None = None, vias: Iterable[str] = ("obligation", "inspection", "approval")) -> DataFrame:
    """``columns`` and ``obligation_id`` of each obligation that a row of ``links`` (``columns``, ``via``, ``via_id``) leads to.

    ``few``: a written table with the ``via`` and ``via_id`` of all links, if these concern a part of the inspections and approvals only.
    ``vias``: those that links may have.
    """
    by = lambda via, name, links=links: links.where(F.col("via") == via).select(*columns, F.col("via_id").alias(name))
    if set(vias) == {"obligation"}:
        return by("obligation", "obligation_id").distinct()
    of = entities(rec)
    if "approval" not in vias:
        if few is not None:
            of = narrowed(of, staged(few.where("via = 'inspection'").select(F.col("via_id").alias("inspection_id")).distinct(), "asked"), "inspection_id")
        through = by("inspection", "inspection_id").join(of.repartition("inspection_id").distinct(), "inspection_id").drop("inspection_id")
        return by("obligation", "obligation_id").unionByName(through).distinct()
    approvals = rec.rows["approvals"].where("row_key IS NOT NULL AND link_readable AND inspection_id IS NOT NULL").select("approval_id", "inspection_id")
    if few is not None:
        asked = lambda via, name: few.where(F.col("via") == via).select(F.col("via_id").alias(name)).distinct()
        approvals = staged(narrowed(approvals, staged(asked("approval", "approval_id"), "asked"), "approval_id"), "asked")
        named = approvals.select("inspection_id").unionByName(asked("inspection", "inspection_id"))
        of = narrowed(of, staged(named.distinct(), "asked"), "inspection_id")
    # where they are joined they are made distinct
    of, approvals = of.repartition("inspection_id").distinct(), approvals.repartition("approval_id").distinct()
    through = by("inspection", "inspection_id").unionByName(by("approval", "approval_id").join(approvals, "approval_id").drop("approval_id"))
    return by("obligation", "obligation_id").unionByName(through.join(of, "inspection_id").drop("inspection_id")).distinct()


def attributed(rec: Records, dataset: str) -> DataFrame:
    """``locator``, ``obligations`` (sorted) and ``unattributable`` of a dataset's rows; a report, as the rules look at pairs."""
    rows = placed(rec, dataset).withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows.select("row", "locator", "via", "via_id", "unattributable"), "attributed")
    pairs = reached(rec, rows.where("via IS NOT NULL"), ["row"]).groupBy("row").agg(F.array_sort(F.collect_set("obligation_id")).alias("obligations"))
    return rows.join(pairs, "row", "left").select("locator", F.coalesce("obligations", F.array().cast("array<string>")).alias("obligations"), "unattributable")


# --- the steps -----------------------------------------------------------------


def _json(**members: Column) -> Column:
    """JSON of members in alphabetical order."""
    return F.to_json(F.struct(*[members[k].alias(k) for k in sorted(members)]), {"ignoreNullFields": "false"})


def unattributable_id(dataset: str) -> Column:
    """A name for a row without a readable key, from its cells."""
    cells = F.when(F.col("malformed"), F.to_json("raw_cells")).otherwise(cells_json(dataset))
    return F.concat(F.lit(f"{dataset}."), F.substring(F.sha2(F.concat(F.lit('{"cells":'), cells, F.lit(f',"dataset":"{dataset}"}}')).cast("binary"), 256), 1, 16))


def dangling(case: Case, rec: Records) -> list[tuple[str, str, str, list[str], Column, DataFrame]]:
    """(dataset, column, target, columns that refer, the target as text, their values that live rows of any dataset have and the target hasn't).

    A target counts as there if its id can be read, in quarantined rows too. References are tested only into targets that claim to be complete.
    Values are looked up, each once, and not the rows that have them.
    """
    inspections = rec.rows["inspections"].where("inspection_id IS NOT NULL").select("inspection_id")
    approvals = rec.rows["approvals"].where("row_key IS NOT NULL").select("approval_id")
    artifacts = rec.rows["artifacts"].where("row_key IS NOT NULL").select("artifact_id", F.col("revision").alias("artifact_revision"))
    tests = [
        ("artifacts", "inspection_id", "inspections", inspections, ["inspection_id"], F.col("inspection_id")),
        ("approvals", "inspection_id", "inspections", inspections, ["inspection_id"], F.col("inspection_id")),
        ("approval_items", "approval_id", "approvals", approvals, ["approval_id"], F.col("approval_id")),
        ("approval_items", "artifact_id", "artifacts", artifacts, ["artifact_id", "artifact_revision"], F.concat_ws("@", "artifact_id", "artifact_revision")),
    ]
    out, lacks = [], {}
    for name, column, target, there, on, shown in tests:
        if case.is_declared_complete(target):
            if (target, *on) not in lacks:
                # a value that lacks does so whoever refers to it, so those of several datasets are looked up together
                asked = _together([rec.live(n).select(*on) for n, _, of, _, by, _ in tests if (of, by) == (target, on)]).distinct()
                if name == "approval_items":
                    # items are few beside what they refer to
                    asked = staged(asked, "referred")
                    there = there.join(few_or_many(asked), on, "left_semi")
                lacks[(target, *on)] = staged(asked.join(there, on, "left_anti"), "missing")
            out.append((name, column, target, on, shown, lacks[(target, *on)]))
    return out


#: Codes of defects that rows of some datasets have alone.
WHERE = {
    "COMPLETED_WITHOUT_TIMESTAMP": ("inspections",), "TIMESTAMP_AFTER_AS_OF": ("inspections", "approvals"),
    "MULTIPLE_CURRENT_REVISIONS": ("inspections", "artifacts"), "DANGLING_REFERENCE": ("artifacts", "approvals", "approval_items"),
}


def datasets_of(codes: Iterable[str]) -> list[str]:
    """The datasets whose rows may have a defect of the ``codes`` (none: any)."""
    found = {n for code in codes for n in WHERE.get(code, DATASETS)}
    return [n for n in DATASETS if n in found or not codes]


def defects(case: Case, rec: Records, codes: tuple[str, ...] = ()) -> DataFrame:
    """One row for each defect and row that has it: ``DEFECT`` columns. With ``codes``, those of these codes, from the datasets that may have them.

    What a row tells by itself is exploded from it; what other rows decide (several current
    revisions, a missing target) is joined to the live rows that it may concern, with what a defect shows of them.
    """
    wanted = lambda code: not codes or code in codes
    rec.rows.together(datasets_of(codes))
    missing = dangling(case, rec) if wanted("DANGLING_REFERENCE") else []
    parts = []
    for name in datasets_of(codes):
        spec, rows = DATASETS[name], placed(rec, name)
        shown = ("dataset", "locator", "via", "via_id", "unattributable")

        def defect(code: str, when: Column, detail: Column | None = None, subject: Column | None = None, spec=spec) -> Column:
            kind, named = (F.col("kind"), F.col("named")) if subject is None else (F.lit(spec.subject), subject)
            text = F.lit(None).cast("string") if detail is None else detail
            return F.when(when, F.struct(kind.alias("kind"), named.alias("subject"), F.lit(code).alias("code"), text.alias("detail")))

        def part(rows: DataFrame, every: Column, shown: tuple[str, ...] = shown) -> None:
            made = rows.select(*shown, F.explode(every).alias("d"))
            parts.append(made.select("dataset", "d.kind", "d.subject", "d.code", "locator", "d.detail", "via", "via_id", "unattributable"))

        live = ~F.col("quarantined")
        found = [
            defect("MALFORMED_ROW", F.col("malformed"), _json(dataset=F.lit(name), field_count=F.size("raw_cells"), header_count=F.col("header_count"))),
            defect("DUPLICATE_KEY", F.col("copies").isNotNull(), F.col("identical").cast("string")),
        ]
        found = [d for code, d in zip(("MALFORMED_ROW", "DUPLICATE_KEY"), found, strict=True) if wanted(code)]
        if name == "inspections" and wanted("COMPLETED_WITHOUT_TIMESTAMP"):
            found.append(defect("COMPLETED_WITHOUT_TIMESTAMP", live & F.col("is_current") & (F.col("completion_status") == "completed") & F.col("completed_at").isNull()))
        if (at := {"inspections": "completed_at", "approvals": "decided_at"}.get(name)) is not None and wanted("TIMESTAMP_AFTER_AS_OF"):
            # canonical times have one width, so their text sorts as they do
            found.append(defect("TIMESTAMP_AFTER_AS_OF", live & (F.col(at) > case.as_of), _json(field=F.lit(at), value=F.col(at))))
        cells = F.transform("violations", lambda v: F.struct(
            F.col("kind").alias("kind"), F.col("named").alias("subject"), v["code"].alias("code"), _json(field=v["field"], value=v["value"], rule=v["rule"]).alias("detail")))
        if not codes or set(codes) & {*CELL_CODES}:
            found = F.concat(cells, F.filter(F.array(*found), lambda d: d.isNotNull())) if found else cells
            part(rows, F.filter(found, lambda d: d["code"].isin(*codes)) if codes else found)
        elif found:
            part(rows, F.filter(F.array(*found), lambda d: d.isNotNull()))
        if name in ("inspections", "artifacts") and wanted("MULTIPLE_CURRENT_REVISIONS"):
            entity = spec.key[0]
            current = rec.live(name).where("is_current")
            many = staged(current.groupBy(entity).agg(F.count("*").alias("n")).where("n > 1").select(entity), "several-current")
            several = defect("MULTIPLE_CURRENT_REVISIONS", F.lit(True), F.col("revision"), F.col(entity))
            part(rows.where(live & F.col("is_current")).join(few_or_many(many), entity, "left_semi"), F.array(several))
        for dataset, column, target, on, key, lacks in missing:
            if dataset == name:
                gone = defect("DANGLING_REFERENCE", F.lit(True), _json(field=F.lit(column), target=F.lit(target), target_key=key))
                part(rows.where(live).join(few_or_many(lacks), on, "left_semi"), F.array(gone))
    return _together(parts)


def contradicted(found: DataFrame) -> DataFrame:
    """``dataset``, ``n``: references into each complete dataset that it does not hold, from the defects."""
    target = F.get_json_object("detail", "$.target")
    return found.where("code = 'DANGLING_REFERENCE'").groupBy(target.alias("dataset")).agg(F.count("*").alias("n"))


def contradictions(case: Case, rec: Records) -> DataFrame:
    """What ``contradicted`` tells of the defects, from the records themselves."""
    gone = [rec.live(name).join(few_or_many(lacks), on, "left_semi").select(F.lit(target).alias("dataset")) for name, _, target, on, _, lacks in dangling(case, rec)]
    if not gone:
        return case.files.sparkSession.createDataFrame([], "dataset string, n long")
    return _together(gone).groupBy("dataset").agg(F.count("*").alias("n"))


def unattributable(rec: Records) -> DataFrame:
    """``dataset`` (the coverage declaration it counts against; ``scope`` for the scope), ``n`` quarantined rows that concern no known obligation."""
    out = None
    for name, spec in DATASETS.items():
        part = placed(rec, name).where("quarantined AND unattributable").select(F.lit(spec.covered_by or name).alias("dataset"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("dataset").agg(F.count("*").alias("n"))


def unattributable_in(found: DataFrame) -> DataFrame:
    """What ``unattributable`` counts, from the defects: a quarantined row has one of its codes at least, and a place of its own."""
    codes = ("MALFORMED_ROW", "DUPLICATE_KEY", *CELL_CODES)
    target = F.create_map(*[F.lit(x) for name, spec in DATASETS.items() for x in (name, spec.covered_by or name)])
    rows = found.where(F.col("unattributable") & F.col("code").isin(*codes)).select("dataset", "locator").distinct()
    return rows.groupBy(F.element_at(target, F.col("dataset")).alias("dataset")).agg(F.count("*").alias("n"))


KEY = ["kind", "subject", "code"]


def finding_key(check: Column, kind: Column, subject: Column, code: Column | None = None) -> Column:
    """check:kind:subject, and #code where a subject may have several findings of a check."""
    base = F.concat_ws(":", check, kind, subject)
    return base if code is None else F.when(code.isNotNull(), F.concat(base, F.lit("#"), code)).otherwise(base)


def concerned(found: DataFrame, rec: Records, codes: tuple[str, ...] = ()) -> DataFrame:
    """``obligation_id``, ``kind``, ``subject``, ``code``: obligations of the scope that a finding (of the ``codes``) concerns."""
    vias = {VIA[name][0] for name in datasets_of(codes)}
    pairs = reached(rec, found.where("via IS NOT NULL").select(*KEY, "via", "via_id").distinct(), KEY, found, vias)
    return pairs.join(rec.obligations, "obligation_id", "left_semi")


def blocking(found: DataFrame, rec: Records) -> DataFrame:
    """``obligation_id``, ``keys`` (sorted): findings that keep an obligation from being judged.

    A finding of which any row concerns no known obligation blocks none; it lowers coverage instead.
    """
    lost = found.groupBy(*KEY).agg(F.bool_or("unattributable").alias("lost")).where("NOT lost").drop("lost")
    pairs = concerned(found, rec).join(lost, KEY, "left_semi")
    key = finding_key(F.lit("R0"), F.col("kind"), F.col("subject"), F.col("code"))
    return pairs.groupBy("obligation_id").agg(F.array_sort(F.collect_set(key)).alias("keys"))


def evidence(found: DataFrame) -> DataFrame:
    """``key``, ``dataset``, ``locator``: the rows that a finding cites."""
    key = finding_key(F.lit("R0"), F.col("kind"), F.col("subject"), F.col("code"))
    return found.select(key.alias("key"), "dataset", "locator").distinct()


def findings(found: DataFrame, rec: Records, codes: tuple[str, ...] = ()) -> DataFrame:
    """Defects (of the ``codes``) merged by subject and code: outcome, requiredness, observed JSON."""
    merged = found.groupBy(*KEY).agg(
        F.countDistinct("dataset", "locator").alias("n_rows"), F.array_sort(F.collect_set("detail")).alias("details"),
        F.bool_or("unattributable").alias("unattributable"),
    )
    known = concerned(found, rec, codes).select(*KEY, F.lit(True).alias("known")).distinct()
    out = merged.join(known, KEY, "left")
    details = F.concat(F.lit("["), F.array_join("details", ","), F.lit("]"))
    n = F.col("n_rows").cast("string")
    first = F.get("details", F.lit(0))
    observed = (
        F.when(F.col("code").isin(*CELL_CODES), F.concat(F.lit('{"count":'), n, F.lit(',"violations":'), details, F.lit("}")))
        .when(F.col("code") == "DUPLICATE_KEY", F.concat(F.lit('{"count":'), n, F.lit(',"identical":'), first, F.lit("}")))
        .when(F.col("code") == "MULTIPLE_CURRENT_REVISIONS", F.concat(F.lit('{"current_revisions":'), F.to_json("details"), F.lit("}")))
        .when(F.col("code").isin("TIMESTAMP_AFTER_AS_OF", "MALFORMED_ROW"), F.concat(F.lit('{"count":'), n, F.lit(","), F.substr(first, F.lit(2))))
        .when(F.col("code") == "DANGLING_REFERENCE", F.concat(F.lit('{"count":'), n, F.lit(',"missing":'), details, F.lit("}")))
        .otherwise(F.concat(F.lit('{"count":'), n, F.lit("}")))
    )
    return out.select(
        F.lit("R0").alias("check_id"), F.col("kind").alias("subject_kind"), F.col("subject").alias("subject_id"), F.col("code").alias("code_suffix"),
        F.when(F.col("code").isin(*FAILING), "FAIL").otherwise("UNKNOWN").alias("outcome"), F.col("code").alias("reason"),
        (F.col("unattributable") | (F.col("kind") == "scope_row") | F.col("known").isNotNull()).alias("required"),
        F.lit("{}").alias("expected"), observed.alias("observed"),
    )
