"""The benchmark tables seen as inspection records.

Orders are the scope, line items inspections and their artifacts, documents the
evidence files, events a second round of approvals. Rules on keys plant every
kind of defect. The same text, but for a few function names, runs in Spark and in
DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.case import Case, Declared, Pack
from ..operators.rules import EVIDENCE_SCHEME
from .staging import few_or_many, is_few, staged, staged_together

PROJECT, REVISION, AS_OF = "NC-001", "S1", "2001-10-25T00:00:00.000000Z"
REQUIREMENTS = {"visual_inspection": ("inspection_report", "photo")}
BASES = (("query_total_matched", "two_pass_stable", "operator_attestation"), ("attested_export",))
TABLES = ("orders", "lineitem", "documents", "events")

#: name -> SQL over TABLES and earlier shapes. {sha(x)}: SHA-256 hex; {day(x, n)}: date n days after x as text; {n}: row number.
SHAPES: dict[str, str] = {
    "line": """
        SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, l_shipdate AS shipped, l_linestatus AS ls, l_returnflag AS rf,
               CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS STRING) AS rank
        FROM lineitem""",
    "n_docs": "SELECT count(*) AS n FROM documents",
    "doc_sha": """SELECT doc_id, {sha("coalesce(text, '')")} AS sha FROM documents""",
    "n_events": "SELECT count(*) AS n FROM events",
    "raw_scope": """
        SELECT 'O-' || CAST(o_orderkey AS STRING) AS obligation_id, 'NC-001' AS project_id, 'S1' AS scope_revision,
               'A-' || CAST(o_orderkey % 97 AS STRING) AS asset_id, CASE WHEN o_orderstatus = 'P' THEN 'leak_survey' ELSE 'visual_inspection' END AS activity_kind,
               'scope.csv' AS file, 2 * o_orderkey + c AS row_number
        FROM orders, (SELECT 0 AS c UNION ALL SELECT 1) AS copies
        WHERE o_orderkey % 10 <> 0 AND (c = 0 OR o_orderkey % 211 = 0)""",
    "raw_inspections": """
        SELECT 'INS-' || CAST(o AS STRING) || '-' || CAST(ln AS STRING) AS inspection_id, CASE WHEN p % 101 = 0 THEN '1' ELSE rank END AS revision,
               CASE WHEN p % 211 = 0 THEN 'TRUE' WHEN ls = 'O' AND ln <= 2 THEN 'true' ELSE 'false' END AS is_current,
               CASE WHEN p % 50 = 0 THEN NULL ELSE 'O-' || CAST(o AS STRING) END AS obligation_id,
               CASE WHEN p % 41 = 0 THEN 'NC-002' ELSE 'NC-001' END AS project_id,
               'A-' || CAST((o + CASE WHEN p % 37 = 0 THEN 1 ELSE 0 END) % 97 AS STRING) AS asset_id,
               CASE WHEN o_orderstatus = 'P' THEN 'leak_survey' ELSE 'visual_inspection' END AS activity_kind,
               CASE WHEN p % 223 = 0 THEN 'done' WHEN rf = 'R' AND p % 5 = 0 THEN 'in_progress' ELSE 'completed' END AS completion_status,
               CASE WHEN s % 61 = 0 THEN NULL WHEN s % 67 = 0 THEN '2024-13-01T00:00:00Z' ELSE {day('shipped', 0)} || 'T10:30:00+02:00' END AS completed_at,
               'inspections.csv' AS file, o * 100 + ln * 10 + CAST(rank AS BIGINT) AS row_number
        FROM line JOIN orders ON o_orderkey = o""",
    "raw_artifacts": """
        SELECT 'ART-' || CAST(o AS STRING) || '-' || CAST(ln AS STRING) || '-' || k AS artifact_id, rank AS revision,
               CASE WHEN ls = 'O' AND ln <= 2 THEN 'true' ELSE 'false' END AS is_current,
               CASE WHEN p % 233 = {lost} THEN 'INS-0-0' ELSE 'INS-' || CAST(o AS STRING) || '-' || CAST(ln AS STRING) END AS inspection_id,
               CASE WHEN k = 'P' AND p % 43 = 0 THEN 'NC-002' ELSE 'NC-001' END AS project_id, 'A-' || CAST(o % 97 AS STRING) AS asset_id,
               CASE WHEN k = 'P' THEN 'photo' ELSE 'inspection_report' END AS document_kind,
               CASE WHEN s % 29 = 0 THEN NULL WHEN p % 227 = 0 THEN 'docs/../' || k
                    ELSE 'docs/' || CAST(o AS STRING) || '/' || CAST(ln AS STRING) || '-' || rank || k || '.txt' END AS relative_path,
               'artifacts.csv' AS file, o * 1000 + ln * 100 + CAST(rank AS BIGINT) * 10 + CASE WHEN k = 'P' THEN 1 ELSE 0 END AS row_number,
               p, s
        FROM line, (SELECT 'R' AS k UNION ALL SELECT 'P') AS kinds
        WHERE NOT (k = 'P' AND p % 11 = 0)""",
    "files": """
        SELECT relative_path, CASE WHEN p % 197 = 0 THEN 'unreadable' WHEN p % 199 = 0 THEN 'too_large' ELSE 'present' END AS status,
               CASE WHEN p % 197 = 0 OR p % 199 = 0 THEN NULL ELSE sha END AS sha256
        FROM raw_artifacts, n_docs JOIN doc_sha ON TRUE
        WHERE doc_id = p % n AND relative_path LIKE 'docs/%/%' AND relative_path NOT LIKE '%..%' AND p % 31 <> 0""",
    "evidence_of": """
        SELECT inspection_id,
               '{{"artifacts":[{{"artifact_id":"' || max(CASE WHEN document_kind = 'inspection_report' THEN artifact_id END) || '","document_kind":"inspection_report","revision":"'
               || max(CASE WHEN document_kind = 'inspection_report' THEN revision END) || '","sha256":"' || max(CASE WHEN document_kind = 'inspection_report' THEN sha256 END)
               || '"}},{{"artifact_id":"' || max(CASE WHEN document_kind = 'photo' THEN artifact_id END) || '","document_kind":"photo","revision":"'
               || max(CASE WHEN document_kind = 'photo' THEN revision END) || '","sha256":"' || max(CASE WHEN document_kind = 'photo' THEN sha256 END)
               || '"}}],"scheme":"{scheme}"}}' AS body
        FROM raw_artifacts JOIN files USING (relative_path) WHERE is_current = 'true' GROUP BY inspection_id""",
    "signed": """
        SELECT 'INS-' || CAST(o AS STRING) || '-' || CAST(ln AS STRING) AS inspection_id, CASE WHEN p % 101 = 0 THEN '1' ELSE rank END AS revision,
               o, ln, p, s, rank, shipped, CASE WHEN s % 5 = 0 THEN NULL WHEN s % 5 = 1 THEN 'sha256:' || {sha("'stale'")} ELSE 'sha256:' || {sha('body')} END AS digest
        FROM line JOIN evidence_of ON inspection_id = 'INS-' || CAST(o AS STRING) || '-' || CAST(ln AS STRING) WHERE ls = 'O' AND ln <= 2""",
    "raw_approvals": """
        SELECT 'APR-' || CAST(o AS STRING) || '-' || CAST(ln AS STRING) || '-' || rank AS approval_id, CASE WHEN p % 239 = {lost} THEN 'INS-0-1' ELSE inspection_id END AS inspection_id,
               CASE WHEN p % 17 = 0 THEN 'old' ELSE revision END AS inspection_revision, digest AS evidence_digest, CASE WHEN p % 13 = 0 THEN 'rejected' ELSE 'approved' END AS decision,
               {day('shipped', 2)} || 'T00:00:00Z' AS decided_at, 'Reviewer ' || CAST(s % 7 AS STRING) AS decided_by,
               'approvals.csv' AS file, o * 1000 + ln * 100 + CAST(rank AS BIGINT) * 10 AS row_number, p, s
        FROM signed WHERE p % 19 <> 0
        UNION ALL
        SELECT 'APR-' || CAST(o AS STRING) || '-' || CAST(ln AS STRING) || '-' || rank || '-X', inspection_id, revision, CASE WHEN s % 7 = 0 THEN NULL ELSE digest END,
               CASE WHEN event_type = 'error' THEN 'revoked' WHEN event_type = 'signup' THEN 'rejected' ELSE 'approved' END,
               CASE WHEN event_type IN ('click', 'signup') THEN {day('shipped', 2)} ELSE {day('shipped', 3)} END || 'T00:00:00.0Z', 'Reviewer X',
               'approvals.csv', o * 1000 + ln * 100 + CAST(rank AS BIGINT) * 10 + 1, p, s
        FROM signed, n_events JOIN events ON TRUE WHERE p % 3 = 0 AND event_id = p % n""",
    "raw_approval_items": """
        SELECT a.approval_id, CASE WHEN a.p % 241 = {lost} THEN 'ART-0' ELSE r.artifact_id END AS artifact_id, r.revision AS artifact_revision,
               'approval_items.csv' AS file, a.row_number * 10 + CASE WHEN r.document_kind = 'photo' THEN 1 ELSE 0 END AS row_number
        FROM raw_approvals a JOIN raw_artifacts r ON r.inspection_id = a.inspection_id
        WHERE a.evidence_digest IS NULL AND r.is_current = 'true' AND a.p % 2 = 0 AND NOT (a.s % 10 = 0 AND r.document_kind = 'photo') AND NOT (a.p % 241 = {lost} AND r.document_kind = 'photo')""",
}


def shape_sql(name: str, duckdb: bool, dangling: bool = True) -> str:
    """The text of a shape in one of the two dialects; without ``dangling``, every reference has its target."""
    text = (SHAPES if duckdb else SHAPES | BY_SPARK)[name].replace("{lost}", "0" if dangling else "-1").replace("{{", "\x01").replace("}}", "\x02").replace("{scheme}", EVIDENCE_SCHEME)
    out, at = "", 0
    while (start := text.find("{", at)) >= 0:
        end = text.index("}", start)
        call, rest = text[start + 1 : end].split("(", 1)
        inner = rest[:-1].strip()
        if call == "sha":
            arg = inner.strip('"') if inner.startswith('"') else inner.strip("'")
            made = f"sha256({arg})" if duckdb else f"sha2({arg}, 256)"
        else:
            column, days = (x.strip().strip("'") for x in inner.split(","))
            made = f"CAST(CAST(CAST({column} AS DATE) + {days} AS DATE) AS STRING)" if duckdb else f"CAST(date_add(CAST({column} AS DATE), {days}) AS STRING)"
        out += text[at:start] + made
        at = end + 1
    return (out + text[at:]).replace("\x01", "{").replace("\x02", "}")


def prelude(dangling: bool = True) -> str:
    """The shapes as DuckDB common table expressions."""
    return ",\n".join(f"{name} AS MATERIALIZED ({shape_sql(name, True, dangling)})" for name in SHAPES)


#: How Spark gets at the same rows with less on the way: shapes that replace those of the same name, or come before them.
#: An order's state is put to its lines where these are ranked, as both need the lines by order; a path is of one artifact, so its file needs no join by path.
BY_SPARK: dict[str, str] = {
    "raw_inspections": SHAPES["raw_inspections"].replace("FROM line JOIN orders ON o_orderkey = o", "FROM ordered"),
    "filed": SHAPES["files"].replace("SELECT relative_path,", "SELECT inspection_id, artifact_id, revision, is_current, document_kind, relative_path,").replace(
        "FROM raw_artifacts, n_docs JOIN doc_sha ON TRUE\n        WHERE doc_id = p % n AND", "FROM raw_artifacts CROSS JOIN n_docs JOIN doc_sha ON doc_id = p % n\n        WHERE"),
    "files": "SELECT relative_path, status, sha256 FROM filed",
    "evidence_of": SHAPES["evidence_of"].replace("FROM raw_artifacts JOIN files USING (relative_path)", "FROM filed"),
}
#: Shapes that are written, those of a tuple side by side: what costs a join or a sort and is read again. Scope, inspections and artifacts are mere
#: projections of written tables, and so are files where texts are few enough. A text is hashed once, not once for each artifact that it stands for.
WAVES = (("line", "doc_sha"), ("signed",), ("raw_approvals",), ("raw_approval_items",))


def shapes(spark: SparkSession, sf_dir: str, dangling: bool = True) -> dict[str, DataFrame]:
    """The shapes as DataFrames; those of ``WAVES`` are written on the way."""
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    due, order = list(WAVES), [n for name in SHAPES for n in (("filed", name) if name == "files" else (name,))]
    for name in order:
        # by its first reader a wave's shapes are all there
        sql, used = shape_sql(name, False, dangling).replace("{", "{{").replace("}", "}}"), {}
        for table in sorted(views, key=len, reverse=True):
            found = re.sub(rf"((?:FROM|JOIN|,)\s+){table}\b(?=[\s,]|$)", rf"\1{{{table}}}", sql)
            if found != sql:
                sql, used[table] = found, views[table]
        views[name] = with_orders(placed(views["lineitem"]), views["orders"]) if name == "line" else spark.sql(sql, **used)
        if due and name == max(due[0], key=order.index):
            views |= staged_together({n: views[n] for n in due.pop(0)}, "shape-")
            if name == "doc_sha":
                if is_few(views["doc_sha"]):
                    views["doc_sha"] = F.broadcast(views["doc_sha"])
                else:
                    due[0] = ("files", *due[0])  # texts too many for a broadcast are met by a shuffle, once
                views["line"] = ranked(views["line"], views["lineitem"])
                views["ordered"] = views["line"].withColumn("o_orderstatus", F.explode("states"))
    return {name: views[name] for name in SHAPES}


#: A line's place among those of its order and number: by the columns that it keeps, and where these are equal by the others.
PLACE, KEPT, OTHERS = ("o", "ln"), ("p", "s", "shipped"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _line(lineitem: DataFrame, *more: str) -> DataFrame:
    names = {"o": "l_orderkey", "ln": "l_linenumber", "p": "l_partkey", "s": "l_suppkey", "shipped": "l_shipdate", "ls": "l_linestatus", "rf": "l_returnflag"}
    return lineitem.select(*[F.col(c).alias(n) for n, c in names.items()], *more)


def placed(lineitem: DataFrame) -> DataFrame:
    """``line`` with ``at`` for its rank, by the columns of ``KEPT`` alone, and ``ties``: how many lines are equal in these. No other column is shuffled."""
    of = Window.partitionBy(*PLACE).orderBy(*KEPT)
    return _line(lineitem).repartition("o").withColumns({"at": F.row_number().over(of), "ties": F.count("*").over(Window.partitionBy(*PLACE, *KEPT))})


def ranked(line: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The written ``placed`` lines with ``rank``; those that tie are read once more, with what breaks their ties."""
    rank = F.col("at").cast("string").alias("rank")
    columns = [c for c in line.columns if c not in ("at", "ties")]
    single, tied = line.where("ties = 1").select(*columns, rank), line.where("ties > 1")
    if tied.isEmpty():
        return single
    keys = [*PLACE, *KEPT]
    first = staged(tied.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.min("at").alias("first"), F.first("states").alias("states")), "tied")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    again = _line(lineitem, *OTHERS).join(few_or_many(first), same)
    again = again.withColumn("at", F.col("first") - 1 + F.row_number().over(Window.partitionBy(*keys).orderBy(*OTHERS)))
    return single.unionByName(staged(again.select(*columns, rank), "untied"))


def with_orders(line: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with ``states``, the state of each order of their key (null: no such order; an order without a state has none of those asked for)."""
    by_key = orders.groupBy(F.col("o_orderkey").alias("o")).agg(F.collect_list(F.coalesce("o_orderstatus", F.lit(""))).alias("states"))
    return line.join(by_key.hint("merge"), "o", "left")  # the orders' files tell little of their size in memory


def pack(binding: str = "digest") -> Pack:
    return Pack(PROJECT, REVISION, REQUIREMENTS, BASES, binding)


def case_of(spark: SparkSession, sf_dir: str, binding: str = "digest", dangling: bool = True, **changes) -> Case:
    """An assessable case over the benchmark tables."""
    made = shapes(spark, sf_dir, dangling)
    names = ("scope", "inspections", "artifacts", "approvals", "approval_items")
    raw = {n: made[f"raw_{n}"].drop("p", "s") for n in names}
    whole = Declared("complete_for_declared_scope", BASES[0], "stable_verified")
    settings = {
        "raw": raw, "files": made["files"], "pack": pack(binding), "project_id": PROJECT, "as_of": AS_OF,
        "declared": dict.fromkeys(("inspections", "artifacts", "approvals", "evidence_files"), whole), "scope_revision": REVISION,
    }
    return Case(**(settings | changes))
