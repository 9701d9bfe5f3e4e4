from tidemill.plans import models, wastage
from tidemill.plans.runlog import RunLog
from tidemill.sources import tables


def test_models_run_log_and_lineage(spark, tmp_path, rows):
    lake = str(tmp_path / "lake")
    bronze = {"orders": f"{lake}/bronze/orders", "customers": f"{lake}/bronze/customers"}
    tables.write_snapshot(spark.createDataFrame(
        [("o1", 1, 5.0, "completed", "2024-01-01", "2024-01-01"),
         ("o1", 1, 6.0, "completed", "2024-01-01", "2024-01-02"),
         ("o2", 2, 1.0, "pending", "2024-01-01", "2024-01-01")],
        "order_id string, customer_id int, order_amount double, order_status string, "
        "created_at string, updated_at string"), bronze["orders"])
    tables.write_snapshot(spark.createDataFrame(
        [(1, "e", "2024-01-01", "eu", "2024-01-01")],
        "customer_id int, email string, signup_date string, region string, updated_at string"),
        bronze["customers"])
    log = RunLog(spark, f"{lake}/runs", f"{lake}/reads")
    built = models.run_models(spark, bronze, lake, log)
    assert [(r[1], r[2]) for r in rows(built["gold.daily_revenue"])] == [("eu", 1)]
    assert spark.table("silver_stg_orders").count() == 2
    [run] = log.runs().collect()
    assert (run["job_name"], run["job_type"], run["rows_written"]) == ("dbt_run", "dbt", 2 + 1 + 1)
    assert sorted(run["input_tables"]) == sorted(bronze.values())
    reads = {r[0] for r in rows(log.reads().select("table_name"))}
    assert reads == set(bronze.values()) | {"silver.stg_orders", "silver.stg_customers"}
    assert rows(wastage.unused_tables(log.runs(), log.reads()).select("table_name")) == [
        ("gold.daily_revenue",)]
    log.record_read("gold.daily_revenue", "dashboard")
    assert wastage.unused_tables(log.runs(), log.reads()).count() == 0
    # Part of the models, on what an earlier run left behind.
    models.run_models(spark, bronze, lake, log, [models.MODELS[2]], "gold_only")
    [run] = log.runs().filter("job_name = 'gold_only'").collect()
    assert run["rows_written"] == 1 and run["input_tables"] == []
    assert tables.table_history(spark, f"{lake}/gold/daily_revenue").count() == 2


def test_names_and_places_are_one_table(spark, tmp_path, rows):
    from tidemill.plans import serving
    path = str(tmp_path / "gold/x")
    frame = spark.createDataFrame([(1, 2)], "x int, y int")
    tables.write_snapshot(frame, path)
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))
    log.record_table("gold.x", path, frame.columns)
    with log.track("a", "dbt") as run:
        run.output_tables = ["gold.x", "nowhere"]
    with log.track("b", "dbt") as run:
        run.output_tables = [path]
    got = wastage.output_columns(log.runs(), log.catalog())
    assert rows(got, "column_name") == [("gold.x", "x"), ("gold.x", "y")]
    unused = wastage.unused_tables(log.runs(), log.reads(), log.catalog()).select("table_name")
    assert rows(unused, "table_name") == [("gold.x",), ("nowhere",)]
    serving.load_gold(spark, path, ["x"], log, "dashboard", frame.schema)
    assert rows(log.reads().select("table_name")) == [("gold.x",)]
    log.record_read(path, "another")
    assert rows(wastage.unused_tables(log.runs(), log.reads(), log.catalog()).select("table_name")) == [("nowhere",)]


def test_models_are_in_the_catalog_for_another_session(spark, tmp_path, rows):
    from tidemill.session import configure
    lake = str(tmp_path / "lake")
    schema = "order_id string, customer_id int, order_amount double, order_status string, created_at string, updated_at string"
    orders = spark.createDataFrame([("o1", 1, 5.0, "completed", "2024-01-01", "2024-01-01")], schema)
    tables.upsert(spark, f"{lake}/bronze/orders", orders, ["order_id"], tables.hashed(["order_id"], 4))  # in slots
    tables.write_snapshot(spark.createDataFrame(
        [(1, "e", "2024-01-01", "eu", "2024-01-01")],
        "customer_id int, email string, signup_date string, region string, updated_at string"), f"{lake}/bronze/customers")
    bronze = {name: f"{lake}/bronze/{name}" for name in ("orders", "customers")}
    log = RunLog(spark, f"{lake}/runs", f"{lake}/reads")
    models.run_models(spark, bronze, lake, log)
    other = configure(spark.newSession())
    assert [tuple(r)[1:3] for r in other.sql("select * from gold.daily_revenue").collect()] == [("eu", 1)]
    assert other.table("silver.stg_orders").count() == 1
    more = spark.createDataFrame([("o2", 1, 7.0, "completed", "2024-01-01", "2024-01-01")], schema)
    tables.upsert(spark, bronze["orders"], more, ["order_id"])
    models.run_models(spark, bronze, lake, log)
    assert [r["order_count"] for r in other.table("gold.daily_revenue").collect()] == [2]
    columns = models.table_columns(spark, ("gold",)).filter("table_name = 'gold.daily_revenue'")
    assert rows(columns.select("column_name", "data_type")) == [
        ("order_date", "timestamp"), ("region", "string"), ("order_count", "bigint"), ("total_revenue", "decimal(20,2)")]
    assert [r["rows_written"] for r in log.runs().orderBy("started_at").collect()] == [3, 4]


def test_view_counts_run_no_view_again(spark, tmp_path):
    """The job that writes gold counts the views it reads; each source row is read once."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    def build(view):
        return view.mapInArrow(seen, view.schema)

    lake = str(tmp_path / "lake")
    tables.write_snapshot(spark.range(0, 40, 1, 4).selectExpr("id as order_id"), f"{lake}/bronze/plain")
    plain = models.Model("silver", "plain_view", models.VIEW, ("bronze.plain",), sql="SELECT order_id FROM {bronze}.plain WHERE order_id > 9")
    table = models.Model("gold", "plain_table", models.TABLE, ("silver.plain_view",), build=build)
    log = RunLog(spark, f"{lake}/runs", f"{lake}/reads")
    models.run_models(spark, {"plain": f"{lake}/bronze/plain"}, lake, log, [plain, table], "once")
    assert read.value == 30
    assert log.runs().first()["rows_written"] == 60
