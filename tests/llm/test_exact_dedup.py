import hashlib
from collections import defaultdict

from attestra.llm import exact_dedup

from . import cases


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        bare = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups[hashlib.sha256(bare.encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, i))
    return {d: (min(g)[3], len(g)) for d, g in groups.items()}


def test_groups_and_winners(spark):
    index = exact_dedup.DigestIndex(spark, exact_dedup.new_table_name(), buckets=4)
    rows = exact_dedup.digests(cases.odd(spark))
    index.add(rows, "a")
    got = exact_dedup.members(rows, index.standing()).collect()
    want = brute(cases.ODD)
    assert {r.digest: (r.keep_id, r.group_size) for r in got} == want
    assert all(r.kept == (r.doc_id == want[r.digest][0]) for r in got)
    index.drop()


def test_batches_in_any_order_give_one_answer(spark):
    want = brute(cases.ODD)
    for cut in (1, 4, 9):
        index = exact_dedup.DigestIndex(spark, exact_dedup.new_table_name(), buckets=4)
        for name, part in (("b", cases.ODD[cut:]), ("a", cases.ODD[:cut]), ("a", cases.ODD[:cut])):  # one of them twice, as after a failure
            index.add(exact_dedup.digests(spark.createDataFrame(part, cases.TEXT)), name)
        assert {r.digest: (r.keep_id, r.group_size) for r in index.standing().collect()} == want
        index.compact()
        assert {r.digest: (r.keep_id, r.group_size) for r in index.standing().collect()} == want
        assert len({f.rsplit("_", 1)[-1] for f in spark.table(index.table).inputFiles()}) == len(spark.table(index.table).inputFiles())  # one file a bucket
        index.drop()


def test_new_rows_meet_the_index_in_a_merge_anti_join(spark, capfd):
    index = exact_dedup.DigestIndex(spark, exact_dedup.new_table_name(), buckets=4)
    index.create()
    known = spark.table(index.table).select("digest")
    groups = exact_dedup.digests(cases.odd(spark)).groupBy("digest").count()
    groups.join(known.hint("merge"), "digest", "left_anti").explain()
    plan = capfd.readouterr().out
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    index.drop()


def test_repeated_rows_and_the_least_id(spark):
    index = exact_dedup.DigestIndex(spark, exact_dedup.new_table_name(), buckets=4)
    rows = [(-(2**63), "x"), (None, "x"), (3, "x"), (None, "y"), (None, "y"), (5, "z"), (5, "z"), (5, "zz")]
    out = exact_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string"), index, "a").collect()
    assert sorted(out, key=str) == sorted([(-(2**63), "x"), (None, "y"), (5, "z"), (5, "zz")], key=str)
    index.drop()


def test_second_batch_meets_the_index(spark):
    index = exact_dedup.DigestIndex(spark, exact_dedup.new_table_name(), buckets=4)
    first = exact_dedup.dedupe(cases.odd(spark), index, "a")
    assert first.columns == cases.odd(spark).columns
    assert sorted(r.doc_id or 0 for r in first.collect()) == sorted(k or 0 for k, _ in brute(cases.ODD).values())
    more = spark.createDataFrame([(50, "one", "en", 1.0), (51, "new", "en", 1.0), (52, "n e w", "en", 1.0)], cases.TEXT)
    assert [r.doc_id for r in exact_dedup.dedupe(more, index, "b").collect()] == [52]
    # the same batch again: nothing is appended twice
    before = spark.table(index.table).count()
    assert [r.doc_id for r in exact_dedup.dedupe(more, index, "b").collect()] == [52]
    assert spark.table(index.table).count() == before == spark.table(index.table).select("digest").distinct().count()
    plan = spark.sql(f"DESCRIBE EXTENDED {index.table}").collect()
    assert any(r.col_name == "Num Buckets" and r.data_type == "4" for r in plan)
    index.drop()


def test_compaction_keeps_all_and_survives_a_crash(spark):
    index = exact_dedup.DigestIndex(spark, exact_dedup.new_table_name(), buckets=2)
    rows = exact_dedup.digests(cases.odd(spark))
    index.add(rows, "a")
    index.add(rows, "b")
    before = sorted(map(tuple, index.standing().collect()))
    index.compact()
    assert sorted(map(tuple, index.standing().collect())) == before
    # a run that ended after the old table stepped aside
    spark.sql(f"ALTER TABLE {index.table} RENAME TO {index.table}_old")
    index.create()
    assert sorted(map(tuple, index.standing().collect())) == before
    index.compact()
    assert sorted(map(tuple, index.standing().collect())) == before
    index.drop()
    assert not any(spark.catalog.tableExists(f"{t}{end}") for t in (index.table, index.again) for end in ("", "_old"))


def test_empty_and_clashing(spark):
    index = exact_dedup.DigestIndex(spark, exact_dedup.new_table_name(), buckets=2)
    assert exact_dedup.dedupe(cases.empty(spark), index, "a").count() == 0
    out = exact_dedup.dedupe(cases.clashing(spark), index, "b")
    assert out.columns == cases.clashing(spark).columns and out.count() == 1
    index.drop()
