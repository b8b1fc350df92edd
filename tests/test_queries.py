"""Every registered query of the engine over the smallest tables against its DuckDB SQL."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from attestra.plans import registry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return con


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(want)


def test_large_joins_are_equi_joins(spark):
    for name in ("q_r7_unmatched", "q_r4_missing_kinds", "q_single_candidate", "q_r3_identity"):
        plan = registry.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
