"""Pages of an export as a table: a Python data source over files ``page-1.json``, ``page-2.json``, ...

A page is ``{"data": [{"3": {"value": 7}, "6": {"value": "x"}}, ...]}``; field 3 is the record id. Tasks read
ranges of pages. The fields asked for are the table's columns (``f6``: canonical JSON of field 6), and no other is
taken out of a record; filters on ``page`` are settled before a file is opened, those on ``rid`` before
a record's values are written.

Edge cases: a gap in the numbers, a page that is no such document, a record without an asked field or
without a positive integral id end the read with ``EXPORT_INVALID``; a folder without pages is an empty table; an
empty page has no records; repeated records are rows of their own; other files in the folder are not opened.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.case import RunError
from .evidence import _file_system, entries, write_files

PAGE = re.compile(r"page-([0-9]+)\.json")
RECORD_ID = 3
BATCH = 5_000


def _invalid(message: str) -> RunError:
    return RunError("EXPORT_INVALID", message)


def integral(value: object) -> int | None:
    """A positive whole number, given as such or as a decimal; anything else is none."""
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value in (float("inf"), float("-inf")):
        return None
    return int(value) if value == int(value) and value >= 1 else None


def _test(f: Filter) -> tuple[str, Callable[[int], bool]] | None:
    """The column (page or rid) and test of a filter that the source settles itself."""
    attribute = getattr(f, "attribute", ())  # a negation has none
    if len(attribute) != 1 or attribute[0] not in ("page", "rid"):
        return None
    value = getattr(f, "value", None)
    made = {
        EqualTo: lambda x: x == value, EqualNullSafe: lambda x: x == value, GreaterThan: lambda x: x > value, GreaterThanOrEqual: lambda x: x >= value, LessThan: lambda x: x < value,
        LessThanOrEqual: lambda x: x <= value, In: lambda x: x in value, IsNotNull: lambda x: True,
    }.get(type(f))
    return made and (attribute[0], made)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.together = options["path"], int(options.get("pages_per_task", "64"))
        self.columns = schema.fieldNames()
        self.fields = {c: c[1:] for c in self.columns if c not in ("page", "pos", "rid")}
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def _passes(self, column: str) -> list[Callable[[int], bool]]:
        return [t for c, t in map(_test, self.filters) if c == column]

    def partitions(self) -> list[InputPartition]:
        """Ranges of the pages that filters leave; the folder is listed once."""
        numbers = sorted(int(m[1]) for name, kind, _ in entries(self.path, "") if kind == "file" and (m := PAGE.fullmatch(name)))
        if numbers != list(range(1, len(numbers) + 1)):
            raise _invalid(f"{self.path}: pages are not numbered 1 to {len(numbers)} without gaps")
        tests = self._passes("page")
        left = [n for n in numbers if all(t(n) for t in tests)]
        return [InputPartition(left[k : k + self.together]) for k in range(0, len(left), self.together)] or [InputPartition([])]

    def _records(self, page: int) -> Iterator[tuple]:
        system, base = _file_system(self.path)
        with system.open_input_stream(f"{base}/page-{page}.json") as f:
            try:
                document = json.loads(f.read())
            except ValueError:
                raise _invalid(f"page {page} is not JSON") from None
        if not isinstance(document, dict) or not isinstance(document.get("data"), list):
            raise _invalid(f"page {page} has no data")
        tests = self._passes("rid")
        for pos, record in enumerate(document["data"]):
            cells = {}
            for field in {str(RECORD_ID), *self.fields.values()}:
                cell = record.get(field) if isinstance(record, dict) else None
                if not isinstance(cell, dict) or "value" not in cell:
                    raise _invalid(f"page {page}: record {pos} lacks field {field}")
                cells[field] = cell["value"]
            if (rid := integral(cells[str(RECORD_ID)])) is None:
                raise _invalid(f"page {page}: record {pos} has no positive integral id")
            if all(t(rid) for t in tests):
                own = {"page": page, "pos": pos, "rid": rid}
                yield tuple(own[c] if c in own else json.dumps(cells[self.fields[c]], sort_keys=True, separators=(",", ":"), ensure_ascii=False) for c in self.columns)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        types = {"page": pa.int32(), "pos": pa.int32(), "rid": pa.int64()}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.string())) for c, v in zip(self.columns, zip(*rows, strict=True), strict=True)], self.columns)

        rows: list[tuple] = []
        for page in partition.value:
            for row in self._records(page):
                rows.append(row)
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class ExportPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "export_pages"

    def schema(self) -> str:
        fields = [f for f in self.options.get("fields", "").split(",") if f]
        return "page int, pos int, rid long" + "".join(f", f{f} string" for f in fields)

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(dict(self.options), schema)


def read_pages(spark: SparkSession, path: str, fields: list[int], pages_per_task: int = 64) -> DataFrame:
    """``page``, ``pos``, ``rid`` and ``f<n>`` (canonical JSON) of each field asked for. Turns on the session's filter pushdown for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ExportPages)
    rows = spark.read.format("export_pages").options(path=path, fields=",".join(map(str, fields)), pages_per_task=str(pages_per_task)).load()
    # Spark 4.1 keeps the filters that were pushed last for a later plan that pushes none: every plan pushes this one
    return rows.where("page IS NOT NULL")


def write_pages(records: DataFrame, path: str, size: int = 1_000) -> int:
    """Write ``rid`` (ids from 1 without gaps) and columns ``f<n>`` of JSON text as pages of ``size`` records in order; how many pages."""
    fields = sorted((c for c in records.columns if c != "rid"), key=lambda c: int(c[1:]))
    values = [(RECORD_ID, F.col("rid").cast("string")), *[(int(c[1:]), F.col(c)) for c in fields]]
    cells = [F.concat(F.lit(f'"{n}":{{"value":'), F.coalesce(value, F.lit("null")), F.lit("}")) for n, value in values]
    record = F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))
    placed = records.select(F.floor((F.col("rid") - 1) / size).cast("int").alias("page"), F.struct("rid", record.alias("text")).alias("x"))
    pages = placed.groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # at most ``size`` records
    body = F.concat(F.lit('{"data":['), F.array_join(F.transform("xs", lambda x: x["text"]), ","), F.lit("]}"))
    return write_files(pages.select(F.concat(F.lit("page-"), (F.col("page") + 1).cast("string"), F.lit(".json")).alias("relative_path"), body.alias("content")), path)
