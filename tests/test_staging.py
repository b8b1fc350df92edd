from pyspark.sql import functions as F

from attestra.sources.staging import FEW_BYTES, few_or_many, narrowed, staged


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [kind for kind in ("BroadcastHashJoin", "SortMergeJoin") if kind in plan]


def test_tables_whose_files_are_small_beside_their_rows_are_not_broadcast(spark):
    ids = spark.range(0, 600_000, 1, 2).select(F.format_string("INS-%s-1", F.col("id").cast("string")).alias("inspection_id"), F.lit(True).alias("is_current"))
    ids = staged(ids, "ids")
    asked = staged(ids.select("inspection_id"), "asked")
    assert joins(asked.join(ids.where("is_current").select("inspection_id"), "inspection_id", "left_anti")) == ["SortMergeJoin"]
    few = staged(ids.limit(100), "few")
    assert joins(asked.join(few, "inspection_id")) == ["BroadcastHashJoin"]
    assert joins(asked.join(F.broadcast(ids), "inspection_id")) == ["BroadcastHashJoin"]


def test_a_table_of_many_bytes_is_not_few(spark):
    numbers = spark.range(0, 1_900_000, 1, 2)
    named = numbers.select(F.format_string("INS-%s-1", F.col("id").cast("string")).alias("id"))
    assert 1_900_000 * 56 > FEW_BYTES
    assert joins(spark.range(3).join(few_or_many(numbers), "id")) == ["BroadcastHashJoin"]
    assert joins(spark.range(3).select(F.col("id").cast("string")).join(few_or_many(named), "id", "left_semi")) == ["SortMergeJoin"]


def test_narrowed_rows_keep_columns_of_any_name(spark):
    rows = spark.range(1000).select("id", F.col("id").cast("string").alias("at"), F.col("id").alias("piece"), F.col("id").alias("bit"))
    asked = staged(spark.range(3, 5), "asked")
    assert {(3, "3", 3, 3), (4, "4", 4, 4)} <= set(map(tuple, narrowed(rows, asked, "id").collect()))
