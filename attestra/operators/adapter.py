"""Exported records to canonical rows, and what the pages of an export prove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..functions.grammar import sanitized_file_name
from ..functions.schema import COMPLETE
from ..sources.sinks import guarded


def first_occurrences(records: DataFrame, key: str = "rid", order: tuple[str, ...] = ("page", "pos")) -> DataFrame:
    """The first record of each id in page order.

    ``min_by`` combines on the map side, so an id that stands on every page costs a
    row for each task; a window would sort them all in one.
    """
    rest = F.struct(*[c for c in records.columns if c != key])
    found = records.groupBy(key).agg(F.min_by(rest, F.struct(*order)).alias("__first"))
    return found.select(key, "__first.*")


def record_id(value: Column) -> Column:
    """An integer record id, also when written as a number with an integral fraction; null for anything else."""
    number = value.try_cast("decimal(38,6)")
    return F.when((number >= 1) & (number == F.floor(number)), number.cast("bigint"))


def resolved_references(rows: DataFrame, targets: DataFrame, column: str, table: str) -> DataFrame:
    """``rows`` with ``resolved``: the target's canonical id, a placeholder where the target is missing.

    ``targets`` has ``rid``, ``canonical``; a target with a null id resolves to null. A
    value that is no record id stays as it is. ``unresolved`` tells placeholders apart.
    """
    there = targets.select(F.col("rid").alias("__rid"), F.col("canonical").alias("__to"), F.lit(True).alias("__there"))
    rid = record_id(F.col(column))
    out = rows.withColumn("__ref", rid).join(there, F.col("__ref") == F.col("__rid"), "left")
    missing = F.col("__ref").isNotNull() & F.col("__there").isNull()
    made = F.concat_ws(".", F.lit("rid"), F.lit(table), F.col("__ref").cast("string"))
    value = F.when(F.col(column).isNull(), None).when(F.col("__ref").isNull(), F.col(column)).when(missing, made).otherwise(F.col("__to"))
    return out.withColumns({"resolved": value, "unresolved": missing}).drop("__ref", "__rid", "__to", "__there")


def mapped_labels(label: Column, values: dict[str, str]) -> tuple[Column, Column]:
    """The canonical value of a label (the label itself if the map lacks it), and whether it is unmapped; empty is null."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), label)
    some = F.when(label != "", label)
    return F.coalesce(F.when(some.isNotNull(), known), some), some.isNotNull() & known.isNull()


def converted(kind: str, value: Column) -> tuple[Column, Column]:
    """(cell, unexpected) of a VARIANT value by its field's type.

    A JSON type that the field can't hold becomes its JSON text and counts as
    unexpected, so that it is never taken for a valid value.
    """
    shape = F.schema_of_variant(value)
    text, void = canonical_json(value), shape == "VOID"
    string = F.try_variant_get(value, "$", "string")
    if kind in ("text", "timestamp"):
        good, cell = shape == "STRING", F.when(string != "", string)
    elif kind in ("numeric", "recordid"):
        number = F.try_variant_get(value, "$", "decimal(38,6)")
        good = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number))
        cell = F.floor(number).cast("bigint").cast("string")
    elif kind == "checkbox":
        good, cell = shape == "BOOLEAN", string
    elif kind == "user":
        email = F.try_variant_get(value, "$.email", "string")
        good, cell = shape.startswith("OBJECT") & email.isNotNull(), F.when(email != "", email)
    elif kind == "choice":
        only = F.try_variant_get(value, "$[0]", "string")
        single = shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.try_variant_get(value, "$[1]", "string").isNull()
        good = (shape == "STRING") | single
        label = F.when(shape == "STRING", string).otherwise(only)
        cell = F.when(label != "", label)
    else:
        raise ValueError(f"no conversion for fields of type {kind}")
    good = F.coalesce(good, F.lit(False))
    return F.when(void | value.isNull(), None).when(good, cell).otherwise(text), ~void & value.isNotNull() & ~good


def latest_versions(versions: DataFrame, key: str = "rid") -> DataFrame:
    """``key``, ``version``, ``file_name`` of the highest version of each attachment; the first listed wins a tie."""
    good = versions.where((F.col("version") >= 1) & F.col("file_name").isNotNull())
    best = good.groupBy(key).agg(F.max_by(F.struct("version", "file_name"), F.struct("version", -F.col("pos"))).alias("b"))
    return best.select(key, "b.version", "b.file_name")


def closed_world(asked: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` with the columns of ``index`` (unique by ``keys``); ``RunError`` with the first key that the index lacks.

    The misses are counted by the job that writes the result; there is no other one.
    """
    found = asked.join(index.withColumn("__there", F.lit(True)), keys, "left")
    shown = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return guarded(found, "closed-world", {"EXPORT_INVALID": F.col("__there").isNull()}, shown).drop("__there")


def attachment_path(table: str, rid: Column, field: int, version: Column, name: Column) -> Column:
    return F.concat(F.lit(f"files/{table}/"), rid.cast("string"), F.lit(f"/{field}/v"), version.cast("string"), F.lit("/"), sanitized_file_name(name))


# --- what pages prove ---------------------------------------------------------------


def page_accounting(pages: DataFrame) -> DataFrame:
    """Whether each page's total fits what was read before it.

    ``pages``: ``table``, ``page``, ``total`` (as the source said with it), ``n`` (records on
    it). A table's pages are few (its records over the page size), so one window of
    page rows is bounded by the number of requests.
    """
    before = Window.partitionBy("table").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("table").orderBy("page")
    left = F.first("total").over(first) - F.coalesce(F.sum("n").over(before), F.lit(0))
    return pages.withColumn("expected", left).withColumn("fits", F.col("total") == F.col("expected"))


def ascending(records: DataFrame) -> DataFrame:
    """``table``, ``ok``: record ids grow strictly within pages and from page to page.

    Each page is reduced to its first and last id and a flag before pages are
    compared, so no window holds a table's records.
    """
    page = Window.partitionBy("table", "page").orderBy("pos")
    steps = records.withColumn("__grows", F.coalesce(F.col("rid") > F.lag("rid").over(page), F.lit(True)))
    pages = steps.groupBy("table", "page").agg(F.bool_and("__grows").alias("grows"), F.min_by("rid", "pos").alias("low"), F.max_by("rid", "pos").alias("high"))
    order = Window.partitionBy("table").orderBy("page")
    joined = pages.withColumn("follows", F.coalesce(F.col("low") > F.lag("high").over(order), F.lit(True)))
    return joined.groupBy("table").agg(F.bool_and(F.col("grows") & F.col("follows")).alias("ok"))


def unstable(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records that two passes saw differently: ``rid``, ``change``; a table is stable if there are none."""
    a, b = first.select("rid", F.struct("modified").alias("a")), second.select("rid", F.struct("modified").alias("b"))
    change = F.when(F.col("a").isNull(), "appeared").when(F.col("b").isNull(), "vanished").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, "rid", "full_outer").select("rid", change.alias("change")).where("change IS NOT NULL")


def earned(facts: DataFrame) -> DataFrame:
    """The coverage that a capture earned: ``coverage``, ``basis``, ``consistency`` from ``whole``, ``stable``, ``attested``."""
    whole, stable, attested = F.col("whole"), F.col("stable"), F.col("attested")
    coverage = F.when(whole & stable & attested, COMPLETE).when(~whole, "partial").otherwise("unverified")
    proofs = F.filter(F.array(F.lit("query_total_matched"), F.when(stable, "two_pass_stable"), F.when(attested, "operator_attestation")), lambda x: x.isNotNull())
    basis = F.when(~whole, F.array(F.lit("pagination_incomplete"))).otherwise(proofs)
    return facts.withColumns({"coverage": coverage, "basis": basis, "consistency": F.when(stable, "stable_verified").otherwise("changed_during_capture")})


def in_scope_artifacts(artifacts: DataFrame, inspections: DataFrame, obligations: DataFrame) -> DataFrame:
    """Current artifacts of inspections that serve an obligation of the scope."""
    serving = inspections.where("obligation_id IS NOT NULL AND inspection_id IS NOT NULL").select("inspection_id", "obligation_id")
    serving = serving.join(obligations.select("obligation_id"), "obligation_id", "left_semi").select("inspection_id")
    return artifacts.where("is_current").join(serving, "inspection_id", "left_semi")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """``page``, ``pos``, ``field``, ``value`` (VARIANT) of the cells of page documents.

    ``pages`` has ``page`` and ``body``, the text of ``{"data": [{"3": {"value": ...}}, ...]}``.
    """
    parsed = pages.select("page", F.try_parse_json("body").alias("v"))
    return parsed.sparkSession.sql("""
        SELECT p.page, r.pos, CAST(c.key AS INT) AS field, try_variant_get(c.value, '$.value', 'variant') AS value
        FROM {pages} p, LATERAL variant_explode(try_variant_get(p.v, '$.data', 'variant')) r, LATERAL variant_explode(r.value) c""", pages=parsed)
