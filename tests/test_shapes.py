"""How the benchmark tables become records: the rows of the SQL, and what is shuffled on the way."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from attestra.operators import integrity, rules
from attestra.sources import shapes
from attestra.sources.staging import staged

from . import support

DATA = Path("/root/testdata/sf0.001")
NAMES = ("raw_scope", "raw_inspections", "raw_artifacts", "files", "raw_approvals", "raw_approval_items")


def shuffled(spark):
    """Bytes that this session has shuffled so far."""
    jsc = spark._jsc.sc()
    jsc.listenerBus().waitUntilEmpty(30_000)
    return jsc.statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.skipif(not DATA.exists(), reason="the benchmark tables are not here")
def test_lines_are_shuffled_once_and_files_not_at_all(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        made = shapes.shapes(spark, str(DATA))
        assert shuffled(spark) - before < 110 * made["line"].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("dangling", (True, False))
def test_shapes_have_the_rows_of_the_sql_for_odd_tables_too(spark, tmp_path, dangling):
    """Orders that lack, stand twice or have no state or key; equal lines, lines of one place, none of a key; a line that lost inspections would meet."""
    duck = duckdb.connect()
    duck.execute(f"""
        CREATE TABLE orders AS SELECT * FROM (VALUES (0, 'O'), (1, 'P'), (1, 'O'), (2, NULL), (3, 'F'), (3, 'F'), (NULL, 'P'), (11, 'P'), (422, 'O')) AS o(o_orderkey, o_orderstatus);
        CREATE TABLE lineitem AS SELECT CASE WHEN i % 50 = 49 THEN NULL ELSE [0, 1, 2, 3, 4, 11, 422][1 + i % 7] END AS l_orderkey, 1 + i * 31 % 700 AS l_partkey, 1 + i % 400 AS l_suppkey, CASE WHEN i % 7 = 0 AND i % 4 = 0 THEN 0 ELSE 1 + i % 3 END AS l_linenumber,
            CAST(i % 50 AS DOUBLE) AS l_quantity, CAST(i AS DOUBLE) AS l_extendedprice, 0.01 AS l_discount, 0.02 AS l_tax, CASE WHEN i % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag, CASE WHEN i % 5 = 0 THEN 'F' ELSE 'O' END AS l_linestatus, TIMESTAMP '1998-01-01' + to_days(CAST(i AS INT)) AS l_shipdate FROM range(1500) r(i);
        CREATE TABLE documents AS SELECT i AS doc_id, CASE WHEN i % 5 = 0 THEN NULL ELSE 'text ' || i END AS text FROM range(23) r(i);
        CREATE TABLE events AS SELECT i AS event_id, ['click', 'error', 'signup', 'view'][1 + i % 4] AS event_type FROM range(17) r(i)""")
    for t in shapes.TABLES:
        duck.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    made = shapes.shapes(spark, str(tmp_path), dangling)
    for name in NAMES:
        columns = made[name].columns
        want = duck.execute(f"WITH {shapes.prelude(dangling)} SELECT {', '.join(columns)} FROM {name}").fetchall()
        assert want and Counter(map(tuple, made[name].collect())) == Counter(want), name


def test_lines_equal_in_what_they_keep_are_ranked_by_their_other_columns(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute(f"""COPY (SELECT CASE WHEN i % 9 = 8 THEN NULL ELSE i % 4 END AS l_orderkey, 7 + i % 2 AS l_partkey, 3 AS l_suppkey, 1 AS l_linenumber, CAST(i * 7 % 11 AS DOUBLE) AS l_quantity, CAST(i * 13 % 101 AS DOUBLE) AS l_extendedprice, 0.01 AS l_discount, 0.02 AS l_tax,
        CASE WHEN i % 3 = 0 THEN 'R' ELSE 'N' END AS l_returnflag, CASE WHEN i % 5 = 0 THEN 'F' ELSE 'O' END AS l_linestatus, TIMESTAMP '1998-01-01' + to_days(CAST(i % 2 AS INT)) AS l_shipdate FROM range(100) r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    duck.execute(f"CREATE TABLE lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    orders = spark.createDataFrame([(0, "P"), (1, "O")], "o_orderkey long, o_orderstatus string")
    lineitem = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    line = staged(shapes.with_orders(shapes.placed(lineitem), orders), "line")
    assert "l_extendedprice" not in line.columns and line.where("ties > 1").count() == 100
    made = shapes.ranked(line, lineitem).select("o", "ln", "p", "s", "shipped", "ls", "rf", "rank")
    assert Counter(map(tuple, made.collect())) == Counter(duck.execute(shapes.shape_sql("line", True)).fetchall())


def test_a_dataset_meets_its_own_repeated_hashes_alone(spark, monkeypatch):
    rows, files = support.clean()
    rows["scope"] += [dict(r) for r in rows["scope"][:2]]
    rows["artifacts"] += [dict(r) for r in rows["artifacts"][:3]]
    sizes = []
    monkeypatch.setattr(integrity, "few_or_many", lambda df: sizes.append(df.count()) or df)
    found = integrity.records(support.case(spark, rows, files)).repeated
    assert sorted((r.dataset, r.copies) for r in found.collect()) == [("artifacts", 2)] * 3 + [("scope", 2)] * 2
    assert max(sizes) == 3


def test_repeated_hashes_are_found_in_half_their_bytes(spark):
    """Hashes met in several tasks, one that fills a third of them, one with the sign bit of its lower half."""
    odd = (5 << 32) + (1 << 31)
    hashes = spark.range(0, 800_000, 1, 2).selectExpr(f"CASE WHEN id % 3 = 0 THEN 77 WHEN id IN (100, 799_999) THEN {odd} WHEN id IN (1, 799_997) THEN 8 ELSE shiftrightunsigned(xxhash64(id), 19) | 1 END AS h".replace("_", ""))
    want = {r.h for r in hashes.groupBy("h").count().where("count > 1").collect()}
    before = shuffled(spark)
    found = [r.h for r in integrity.twice(hashes).collect()]
    assert sorted(found) == sorted(want) and {8, 77, odd} <= want
    assert shuffled(spark) - before < 5.5 * 800_000 * 2 / 3


def test_repeated_hashes_need_no_row_of_memory_each(spark):
    n = 2_000_000
    hashes = spark.range(0, n, 1, 2).selectExpr("CASE WHEN id % 2 = 0 AND id < 6 THEN 8L ELSE shiftrightunsigned(xxhash64(id), 19) END AS h")
    spark.sparkContext.setJobGroup("repeated hashes", "")
    try:
        assert [r.h for r in integrity.twice(hashes).collect()] == [8]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in tracker.getJobIdsForGroup("repeated hashes") for s in tracker.getJobInfo(j).stageIds}
    used = [store.lastStageAttempt(s) for s in stages if tracker.getStageInfo(s).numCompletedTasks]
    assert used and sum(s.peakExecutionMemory() for s in used) < 100 * n


def test_links_of_few_records_leave_the_other_inspections_where_they_are(spark):
    rows, files = support.clean(3000)
    rec = integrity.records(support.case(spark, rows, files))
    links = spark.createDataFrame([("a", "inspection", "I-7"), ("b", "approval", "Q-8"), ("c", "obligation", "O-9"), ("d", "inspection", "I-0")], "key string, via string, via_id string")
    links = staged(links, "links")
    want = {("a", "O-7"), ("b", "O-8"), ("c", "O-9")}
    assert {tuple(r) for r in integrity.reached(rec, links, ["key"]).collect()} == want
    before = shuffled(spark)
    assert {tuple(r) for r in integrity.reached(rec, links, ["key"], links).collect()} == want
    assert shuffled(spark) - before < 10_000


def test_superseded_inspections_are_only_counted(spark):
    columns = "inspection_id string, revision string, is_current boolean, obligation_id string, project_id string, asset_id string, activity_kind string, completion_status string"
    row = lambda i, r, now, o: (i, r, now, o, "P", "A", "visual", "completed")
    inspections = spark.createDataFrame([row("I-1", "1", False, "O-1"), row("I-1", "2", True, "O-1"), row("I-2", "1", False, "O-2"), row("I-3", "1", None, "O-3"), row("I-4", "1", True, None)], columns)
    scope = spark.createDataFrame([(f"O-{k}", "P", "A", "visual") for k in (1, 2, 3, 4)], "obligation_id string, project_id string, asset_id string, activity_kind string")
    found = rules.cardinality(scope, inspections)
    told = {(r.obligation_id, r.n_current, r.n_completed, r.n_superseded, tuple(r.current), r.candidate and r.candidate.revision) for r in found.collect()}
    assert told == {("O-1", 1, 1, 1, ("I-1@2",), "2"), ("O-2", 0, 0, 1, (), None), ("O-3", 0, 0, 0, (), None), ("O-4", 0, 0, 0, (), None)}
    # the sort of lists and structs doesn't see them
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Filter" in p and "is_current" in p for p in plan)
