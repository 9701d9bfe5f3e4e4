from pyspark.sql import functions as F

from tidemill.plans import retrieval, revenue, serving
from tidemill.plans.runlog import RunLog
from tidemill.sources import tables


def test_load_gold_logs_the_read(spark, tmp_path, rows):
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))
    path = str(tmp_path / "gold")
    schema = spark.createDataFrame([], "d int, v string").schema
    args = (spark, path, ["d"], log, "dashboard", schema, "gold.x")
    assert serving.load_gold(*args).count() == 0 and log.reads().count() == 0
    tables.write_snapshot(spark.createDataFrame([(2, "b"), (None, "n"), (1, "a")], schema), path)
    assert rows(serving.load_gold(*args)) == [(1, "a"), (2, "b"), (None, "n")]
    assert rows(log.reads().select("table_name", "reader_job")) == [("gold.x", "dashboard")]


def test_serving_aggregates(spark, rows):
    gold = spark.createDataFrame(
        [("2024-01-01", "eu", 2.0), ("2024-01-01", None, 1.0), ("2024-01-02", "us", 5.0)],
        "order_date string, region string, total_revenue double")
    assert rows(revenue.revenue_by_day(gold)) == [("2024-01-01", 3.0), ("2024-01-02", 5.0)]
    assert rows(revenue.revenue_by_region(gold)) == [("us", 5.0), ("eu", 2.0)]
    windows = spark.createDataFrame([(1, "a", 3), (1, "a", 5), (2, "b", 1)],
                                    "window_start int, event_type string, event_count long")
    assert rows(revenue.event_pivot(windows, ["a", "b"])) == [(1, 4.0, 0.0), (2, 0.0, 1.0)]


def test_runs_of_one_type_prune_partitions(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))
    log.end(log.start("a", "dbt"))
    log.end(log.start("b", "streaming"))
    only = log.runs("dbt")
    assert [r["job_name"] for r in only.collect()] == ["a"]
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(job_type" in plan


def test_key_check_of_an_upsert_skips_the_model(spark):
    docs = spark.createDataFrame([("a", "text")], "source string, text string")
    keys = retrieval.embed(retrieval.chunk(docs)).groupBy("id").agg(F.count(F.lit(1)))
    assert "Python" not in keys._jdf.queryExecution().executedPlan().toString()
