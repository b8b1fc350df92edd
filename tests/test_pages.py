"""Export pages as a table: columns asked for, filters settled by the source, and what ends a read."""

import json

import pytest
from pyspark.sql import functions as F

from attestra.sources import pages


def put(path, numbers, record=lambda n, k: {"3": {"value": 10 * n + k}, "6": {"value": {"b": n, "a": "é"}}, "7": {"value": None}}):
    for n in numbers:
        (path / f"page-{n}.json").write_text(json.dumps({"data": [record(n, k) for k in range(3)], "more": 1}))


def test_columns_filters_and_ranges(spark, tmp_path):
    put(tmp_path, range(1, 11))
    (tmp_path / "notes.txt").write_text("not a page")
    table = pages.read_pages(spark, str(tmp_path), [6], 3)
    assert table.columns == ["page", "pos", "rid", "f6"]
    rows = sorted(map(tuple, table.collect()))
    assert rows == [(n, k, 10 * n + k, f'{{"a":"é","b":{n}}}') for n in range(1, 11) for k in range(3)]
    assert table.rdd.getNumPartitions() == 4
    some = table.where((F.col("page") > 2) & (F.col("page") <= 9) & F.col("rid").isin(31, 32, 95, 101, 90) & (F.col("f6") != "x"))
    assert sorted(r.rid for r in some.collect()) == [31, 32, 90]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "(page#" not in plan.split("Filter")[1].split("\n")[0] and "rid#" not in plan.split("Filter")[1].split("\n")[0]  # only f6 is left to Spark
    # pages that a filter leaves out aren't opened
    (tmp_path / "page-2.json").write_text("not JSON")
    assert table.where("page >= 3").count() == 24
    with pytest.raises(Exception, match="page 2 is not JSON"):
        table.count()


@pytest.mark.parametrize(
    ("cell", "message"),
    [({"6": {"value": 1}}, "lacks field 3"), ({"3": {"value": 1}}, "lacks field 6"), ({"3": {"value": 0}, "6": {"value": 1}}, "no positive integral id"), ({"3": {"value": True}, "6": {"value": 1}}, "no positive integral id"), ({"3": {"value": 1.5}, "6": {"value": 1}}, "no positive integral id"), ({"3": 4, "6": {"value": 1}}, "lacks field 3"), (7, "lacks field")],
)
def test_records_that_end_a_read(spark, tmp_path, cell, message):
    put(tmp_path, [1], lambda n, k: cell)
    with pytest.raises(Exception, match=message):
        pages.read_pages(spark, str(tmp_path), [6]).collect()


def test_gaps_and_empty_folders(spark, tmp_path):
    assert pages.read_pages(spark, str(tmp_path), [6]).count() == 0
    put(tmp_path, [1, 2, 4])
    with pytest.raises(Exception, match="without gaps"):
        pages.read_pages(spark, str(tmp_path), [6]).count()
    assert [pages.integral(x) for x in (3, 3.0, 3.5, "3", None, float("nan"), float("inf"), -1)] == [3, 3, None, None, None, None, None, None]


def test_written_pages_are_read_back(spark, tmp_path):
    rows = [(k, json.dumps({"k": k}), None) for k in range(1, 24)]
    n = pages.write_pages(spark.createDataFrame(rows, "rid long, f6 string, f9 string"), str(tmp_path / "x"), 5)
    got = sorted((r.rid, r.page, r.pos, json.loads(r.f6)["k"], r.f9) for r in pages.read_pages(spark, str(tmp_path / "x"), [6, 9]).collect())
    assert n == 5 and got == [(k, (k - 1) // 5 + 1, (k - 1) % 5, k, "null") for k in range(1, 24)]
