"""Cells to typed values, and what is wrong with them: one projection for a dataset, nothing shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import checked, parsed
from ..functions.schema import DATASETS

VIOLATIONS = "array<struct<code:string,field:string,value:string,rule:string>>"


def cells_json(dataset: str) -> Column:
    """Canonical JSON of a row's raw cells: members in alphabetical order, nulls kept."""
    names = sorted(f.name for f in DATASETS[dataset].fields)
    return F.to_json(F.struct(*[F.col(f"raw.{n}").alias(n) for n in names]), {"ignoreNullFields": "false"})


def place() -> Column:
    """Where a row stands that tells no place of its own."""
    return F.concat("file", F.lit("#row="), F.col("row_number").cast("string"))


def validated(raw: DataFrame, dataset: str, unmapped: DataFrame | None = None) -> DataFrame:
    """Typed columns beside ``raw`` (struct of the cells as read), ``violations``, ``row_key``,
    ``subject``, ``link_readable``, ``malformed``, ``locator`` and the parts it is made of.

    ``raw`` has the dataset's columns as strings, ``file``, ``row_number`` and
    optionally ``x_source``, ``malformed``, ``raw_cells`` and ``header_count``. ``unmapped`` (dataset, source, field)
    lists cells whose label no value map knew: these are violations whatever they hold.
    """
    spec = DATASETS[dataset]
    rows = raw
    for name, default in (("x_source", F.lit(None).cast("string")), ("malformed", F.lit(False)), ("raw_cells", F.lit(None).cast("array<string>")), ("header_count", F.lit(None).cast("int"))):
        if name not in rows.columns:
            rows = rows.withColumn(name, default)
    if unmapped is None:
        rows = rows.withColumn("__listed", F.array().cast("array<string>"))
    else:
        listed = unmapped.where(F.col("dataset") == dataset).groupBy(F.col("source").alias("__source")).agg(F.collect_set("field").alias("__listed"))
        rows = rows.join(listed, F.coalesce("x_source", F.lit("")) == F.col("__source"), "left")
        rows = rows.withColumn("__listed", F.coalesce("__listed", F.array().cast("array<string>")))
    # three projections, each naming what the one before computed: cells, then values and rules, then codes
    rows = rows.withColumns({f"__x_{f.name}": e for f in spec.fields if (e := parsed(f.kind, F.col(f.name))) is not None})
    judged = {f.name: checked(f.kind, F.col(f.name), F.col(f"__x_{f.name}"), f.required) for f in spec.fields}
    rows = rows.withColumns({f"__r_{n}": rule for n, (_, rule) in judged.items()})
    values, violations, bad = {}, [], {}
    for f in spec.fields:
        cell, rule, listed = F.col(f.name), F.col(f"__r_{f.name}"), F.array_contains("__listed", f.name)
        bad[f.name] = ~F.col("malformed") & (listed | rule.isNotNull())
        values[f.name] = F.when(~bad[f.name] & ~F.col("malformed"), judged[f.name][0])
        code = F.when(listed, "UNMAPPED_VALUE").when(rule.startswith("path:"), "INVALID_PATH").otherwise("INVALID_VALUE")
        found = F.struct(code.alias("code"), F.lit(f.name).alias("field"), cell.alias("value"), F.when(listed, "unmapped").otherwise(rule).alias("rule"))
        violations.append(F.when(bad[f.name], found))
    readable = ~F.col("malformed")
    for k in spec.key:
        readable &= ~bad[k]
    key = F.when(readable, F.array(*[F.col(k) for k in spec.key]))
    link = ~F.col("malformed") & (~bad[spec.link] if spec.link else F.lit(True))
    return rows.select(
        *[v.alias(n) for n, v in values.items()],
        F.struct(*[F.col(f.name) for f in spec.fields]).alias("raw"),
        F.filter(F.array(*violations), lambda v: v.isNotNull()).cast(VIOLATIONS).alias("violations"),
        key.alias("row_key"),
        F.when(readable, F.concat_ws(spec.between, *[F.col(k) for k in spec.key])).alias("subject"),
        link.alias("link_readable"),
        "malformed",
        "raw_cells",
        "header_count",
        F.coalesce("x_source", place()).alias("locator"),
        "file",
        "row_number",
        F.lit(dataset).alias("dataset"),
    )
