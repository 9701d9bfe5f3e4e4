"""Every registered query against its SQL on the small test tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry
from compare import SAME, TABLES, canonical
from tidemill.workload.oracles import ORACLES
from tidemill.workload.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).columns == ["order_date", "region", "order_count", "total_revenue"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    sql = ORACLES[name]
    types = {row[0]: row[1] for row in db.execute("DESCRIBE " + sql).fetchall()}
    assert types == {f.name: SAME.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
                     for f in df.schema.fields}
    want = db.execute(sql)
    columns = [d[0] for d in want.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == \
        canonical(columns, want.fetchall())


@pytest.mark.parametrize("name", ["daily_revenue", "latest_lineitem", "chunk_packed",
                                  "unused_tables", "runtime_trend", "window_counts_1min"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "CartesianProduct", "NestedLoop"):
        assert word not in plan


def test_scan_reads_needed_columns_only(spark):
    plan = QUERIES["window_counts_1min"](spark, SF_DIR)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    plan = QUERIES["revenue_by_day"](spark, SF_DIR)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "o_orderpriority" not in plan
