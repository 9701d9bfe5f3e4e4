"""One query per capability, over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.functions import text as tx
from tidemill.operators.dedupe import latest_by_key
from tidemill.operators import pivots
from tidemill.operators.nearest import nearest, nearest_to
from tidemill.operators.quality import check_not_null, check_unique
from tidemill.plans import (
    lineage, models, questions, reports, retrieval, revenue, runlog, serving, wastage,
)
from tidemill.session import configure, scratch_path
from tidemill.sources import corpus, raw, tables
from tidemill.streaming import windows
from tidemill.workload import relations as rel

Query = Callable[[SparkSession, str], DataFrame]

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EMBED_DIMS = 64
MONEY = "decimal(20,2)"


# -- batch lakehouse ---------------------------------------------------------

def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = revenue.stg_orders(rel.bronze_orders(spark, sf_dir))
    customers = revenue.stg_customers(rel.bronze_customers(spark, sf_dir))
    return revenue.daily_revenue(orders, customers, status="F")


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.naive(_gold(spark, sf_dir).withColumn(
        "total_revenue", F.col("total_revenue").cast(MONEY)))


def revenue_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.naive(revenue.revenue_by_day(_gold(spark, sf_dir)).withColumn(
        "total_revenue", F.col("total_revenue").cast(MONEY)))


def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue.revenue_by_region(_gold(spark, sf_dir)).withColumn(
        "total_revenue", F.col("total_revenue").cast(MONEY))


def latest_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice",
             "l_quantity", "l_discount", "l_tax"]
    return rel.naive(latest_by_key(
        rel.load(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey",
            "l_extendedprice", "l_quantity", "l_discount", "l_tax"),
        ["l_orderkey", "l_linenumber"], order))


def latest_customer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.naive(latest_by_key(
        rel.load(spark, sf_dir, "orders").select(
            "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"),
        ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]))


def sample_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = rel.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return revenue.sample(orders, "o_orderkey", 10)


def bronze_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON and CSV drops to bronze by configuration, then silver and gold on top."""
    root = scratch_path(spark, "ingest")
    (rel.bronze_orders(spark, sf_dir).withColumn("order_id", F.col("order_id").cast("string"))
     .write.json(f"{root}/raw/orders"))
    (rel.bronze_customers(spark, sf_dir).write.option("header", True)
     .csv(f"{root}/raw/customers"))
    ddl = {"orders": schemas.ORDERS_RAW, "customers": schemas.CUSTOMERS_RAW}
    specs = [raw.SourceSpec(name, fmt, f"raw/{name}", f"bronze/{name}",
                            schema=", ".join(f"{f.name} {f.dataType.simpleString()}"
                                             for f in ddl[name].fields))
             for name, fmt in (("orders", "json"), ("customers", "csv"))]
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    bronze = raw.ingest_all(spark, specs, log, root)
    gold = revenue.daily_revenue(revenue.stg_orders(bronze["orders"]),
                                 revenue.stg_customers(bronze["customers"]), status="F")
    return rel.naive(gold.withColumn("total_revenue", F.col("total_revenue").cast(MONEY)))


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drops merged by key: the second has new keys at old markers, late rows and null markers."""
    root = scratch_path(spark, "incremental")
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    price = F.col("o_totalprice").cast("decimal(12,2)")
    orders = rel.load(spark, sf_dir, "orders")

    def rows(condition: str, amount, marker) -> DataFrame:
        return orders.filter(condition).select(
            key.cast("string").alias("order_id"), amount.cast("double").alias("order_amount"),
            marker.cast("string").alias("updated_at"))

    stamped = F.when(key % 11 != 0, day)
    rows("o_orderkey % 3 <> 0", price, stamped).write.json(f"{root}/raw")
    spec = raw.SourceSpec("orders", "json", "raw", "bronze", "order_id", "updated_at",
                          schema="order_id string, order_amount double, updated_at string")
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    raw.ingest(spark, spec, log, root, incremental=True)
    (rows("o_orderkey % 3 = 0", price, stamped)
     .unionByName(rows("o_orderkey % 5 = 0", price + 1, F.date_add(day, 1)))
     .unionByName(rows("o_orderkey % 7 = 0", price - 1, F.date_sub(day, 1)))
     .write.mode("append").json(f"{root}/raw"))
    loaded = raw.ingest(spark, spec, log, root, incremental=True)
    return loaded.select("order_id", F.col("order_amount").cast("decimal(12,2)").alias("order_amount"), "updated_at")


def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three drops, a load after each and one more: every load reads the files that are new to it."""
    root = scratch_path(configure(spark), "files")
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    orders = rel.load(spark, sf_dir, "orders")

    def rows(condition: str, marker) -> DataFrame:
        return orders.filter(condition).select(key.alias("order_id"), "o_orderstatus", marker.alias("updated_at"))

    drops = [rows("o_orderkey % 3 = 0", day), rows("o_orderkey % 3 = 1", day),
             rows("o_orderkey % 3 = 2", day).unionByName(rows("o_orderkey % 5 = 0", F.date_add(day, 1)))
             .unionByName(rows("o_orderkey % 7 = 0", F.date_sub(day, 1))), None]
    spec = raw.SourceSpec("orders", "json", "raw", "bronze", "order_id", "updated_at",
                          schema="order_id bigint, o_orderstatus string, updated_at date")
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    for drop in drops:
        if drop is not None:
            drop.write.mode("append").json(f"{root}/raw")
        raw.ingest(spark, spec, log, root, incremental=True)
    load = F.row_number().over(Window.orderBy("started_at"))  # four runs
    return log.runs().select(load.alias("load"), "rows_read", "rows_written")


def _headed(batches):
    """A file's lines below a header."""
    yield pa.RecordBatch.from_pydict({"value": ["customer_id,balance"]})
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("value")], ["value"])


def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and rejected rows, by reason, of JSON and CSV drops and of a stream of events."""
    root = scratch_path(configure(spark), "quarantine")
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    key, cust = F.col("o_orderkey"), F.col("c_custkey")
    amount = F.when(key % 17 == 0, F.lit('"much"')).otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat(F.lit('{"order_id": '), F.when(key % 19 == 0, "null").otherwise(key.cast("string")),
                    F.lit(', "order_amount": '), amount, F.when(key % 13 == 0, "").otherwise("}"))
    rel.load(spark, sf_dir, "orders").select(line).write.text(f"{root}/raw/orders")
    line = F.concat_ws(",", cust, F.when(cust % 11 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")),
                       F.when(cust % 13 == 0, "more"))
    (rel.load(spark, sf_dir, "customer").select(line.alias("value"))
     .mapInArrow(_headed, "value string").write.text(f"{root}/raw/customers"))
    counted = []
    for name, kind, schema, column in (("orders", "json", "order_id bigint, order_amount double", "order_id"),
                                       ("customers", "csv", "customer_id bigint, balance double", "customer_id")):
        spec = raw.SourceSpec(name, kind, f"raw/{name}", f"bronze/{name}", column, schema=schema,
                              quarantine=f"bad/{name}", pattern="*.txt")
        good = raw.ingest(spark, spec, log, root).select(F.lit("good").alias("reason"))
        counted.append(good.unionByName(raw.read_quarantine(spark, spec, root).select("reason"))
                       .select(F.lit(name).alias("source"), "reason"))
    user = F.col("user_id")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    event = F.to_json(F.struct(user.cast("string").alias("session_id"), "event_type", F.when(
        user % 7 != 0, F.when(user % 5 == 0, "noon").otherwise(at)).alias("event_time")))
    (rel.load(spark, sf_dir, "events").select(F.when(user % 3 == 0, F.concat(event, F.lit("]"))).otherwise(event))
     .write.text(f"{root}/raw/events"))
    windows.part_events(windows.file_events(spark, f"{root}/raw/events"), f"{root}/events",
                        f"{root}/checkpoint").awaitTermination()
    counted.append(spark.read.parquet(f"{root}/events").select(
        F.lit("events").alias("source"), F.coalesce("reason", F.lit("good")).alias("reason")))
    return reduce(DataFrame.unionByName, counted).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("rows"))


def csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV drops with other columns in another order, read by name: declared and inferred types."""
    root = scratch_path(spark, "csv")
    customers = rel.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("email"), F.col("c_acctbal").alias("balance"))
    (customers.filter("customer_id % 2 = 0").select("email", "balance", "customer_id")
     .write.option("header", True).csv(f"{root}/raw"))
    (customers.filter("customer_id % 2 = 1").select("customer_id", "balance")
     .write.mode("append").option("header", True).csv(f"{root}/raw"))
    declared = raw.read_raw(spark, raw.SourceSpec(
        "customers", "csv", "raw", "b", schema="customer_id bigint, email string, balance double"), root)
    inferred = raw.read_raw(spark, raw.SourceSpec("customers", "csv", "raw", "b"), root)
    columns = ["customer_id", "email", "balance"]
    return (declared.select(F.lit("declared").alias("how"), *columns)
            .unionByName(inferred.select(F.lit("inferred").alias("how"), *columns)))


def csv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV drops with bars between cells, and cells that hold bars, quotes and line breaks, by name."""
    root = scratch_path(spark, "csv-options")
    note = F.concat(F.lit('a "note"\non |'), F.col("c_custkey").cast("string"))
    customers = rel.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), note.alias("note"), F.col("c_mktsegment").alias("segment"))
    options = {"sep": "|", "escape": '"', "quote": '"', "header": "true"}
    for columns, half in ((["note", "customer_id"], 0), (["segment", "customer_id", "note"], 1)):
        (customers.filter(F.col("customer_id") % 2 == half).select(*columns)
         .write.mode("append").options(**options).csv(f"{root}/raw"))
    spec = raw.SourceSpec("customers", "csv", "raw", "b", schema="customer_id bigint, note string, segment string",
                          options={**options, "multiLine": "true"})
    return raw.read_raw(spark, spec, root).select("customer_id", "note", "segment")


def load_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and load times of bronze tables, read through views in SQL; a table not there yet is empty."""
    root = scratch_path(configure(spark), "stamps")
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    rel.bronze_orders(spark, sf_dir).write.json(f"{root}/raw/orders")
    rel.bronze_customers(spark, sf_dir).write.option("header", True).csv(f"{root}/raw/customers")
    specs = [raw.SourceSpec("orders", "json", "raw/orders", "bronze/orders"),
             raw.SourceSpec("customers", "csv", "raw/customers", "bronze/customers")]
    raw.ingest_all(spark, specs, log, root)
    tables.register_views(spark, {f"bronze_{spec.name}": f"{root}/{spec.bronze_table}" for spec in specs})
    none = tables.read_table(spark, f"{root}/bronze/none", schema_if_missing=spark.table("bronze_orders").schema)
    none.createOrReplaceTempView("bronze_none")
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{name}' AS source, count(*) AS rows, count(DISTINCT _ingested_at) AS loads FROM bronze_{name}"
        for name in ("orders", "customers", "none")))


def _model_runs(spark: SparkSession, sf_dir: str) -> runlog.RunLog:
    """Bronze tables of the orders and customers, and the models built on them."""
    root = scratch_path(spark, "models")
    bronze = {"orders": f"{root}/bronze/orders", "customers": f"{root}/bronze/customers"}
    orders = rel.bronze_orders(spark, sf_dir).withColumn("order_status", F.when(
        F.col("order_status") == "F", "completed").otherwise("pending"))
    tables.write_snapshot(orders, bronze["orders"])
    tables.write_snapshot(rel.bronze_customers(spark, sf_dir), bronze["customers"])
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    models.run_models(spark, bronze, f"{root}/lake", log)
    return log


def model_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_runs(spark, sf_dir).runs().select(
        "job_name", "job_type", "status", "rows_written",
        F.array_join(F.array_sort("output_tables"), ",").alias("output_tables"))


def model_schema_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs that share a fifth of their columns, names and places alike."""
    log = _model_runs(spark, sf_dir)
    pairs = wastage.duplicate_schemas(wastage.output_columns(log.runs(), log.catalog()), 0.2)
    return pairs.select("table_a", "table_b", F.round("overlap", 6).alias("overlap"),
                        F.array_join("shared_columns", ",").alias("shared_columns"))


def catalog_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold table by its name in the catalog, from another session."""
    _model_runs(spark, sf_dir)
    other = configure(spark.newSession())
    return rel.naive(other.sql(f"SELECT order_date, region, order_count, CAST(total_revenue AS {MONEY}) AS total_revenue "
                               "FROM gold.daily_revenue"))


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog knows of the models, and the rows behind each name."""
    _model_runs(spark, sf_dir)
    known = models.table_columns(spark).filter("table_name in ('silver.stg_orders', 'silver.stg_customers', 'gold.daily_revenue')")
    rows = reduce(DataFrame.unionByName, [
        spark.table(name).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name))
        for name in ("silver.stg_orders", "silver.stg_customers", "gold.daily_revenue")])
    return known.join(rows, "table_name")


def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that stops at a failed check, as the run log shows it."""
    root = scratch_path(spark, "failed")
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    customers = rel.load(spark, sf_dir, "customer").withColumn(
        "c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    try:
        with log.track("check_segments", "batch_ingestion", ["bronze/customers"]):
            missing = check_not_null(customers, "customer", ["c_mktsegment"]).first()["failures"]
            raise ValueError(f"{missing} customers without a segment")
    except ValueError:
        log.compact()  # readers start from the snapshot
    return log.runs().select("job_name", "job_type", "status", "error_message")


def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads recorded in bulk, and one by a dashboard that loads a table by its place."""
    root = scratch_path(spark, "reads")
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    log.record_reads(rel.table_reads(spark, sf_dir))
    orders = rel.bronze_orders(spark, sf_dir)
    tables.write_snapshot(orders, f"{root}/gold/orders")
    log.record_table("gold.orders", f"{root}/gold/orders", orders.columns)
    serving.load_gold(spark, f"{root}/gold/orders", ["order_id"], log, "dashboard", orders.schema)
    return log.reads().groupBy("table_name", "reader_job").agg(F.count(F.lit(1)).alias("reads"))


def _upserted(spark: SparkSession, sf_dir: str, slot: str | None = None) -> str:
    """A table of the orders not in status P, then merged with those not in F, one dearer."""
    path = scratch_path(spark, "orders")
    orders = rel.load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    if slot:
        tables.upsert(spark, path, orders.filter("o_orderstatus <> 'P'"), ["o_orderkey"], slot)
    else:
        tables.write_snapshot(orders.filter("o_orderstatus <> 'P'"), path)
    dearer = orders.filter("o_orderstatus <> 'F'").withColumn(
        "price", (F.col("price") + 1).cast("decimal(12,2)"))
    tables.upsert(spark, path, dearer, ["o_orderkey"])
    return path


def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, _upserted(spark, sf_dir, tables.hashed(["o_orderkey"], 16)))


def time_travel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _upserted(spark, sf_dir)
    counts = [tables.read_table(spark, path, version).agg(F.count(F.lit(1)).alias("rows"))
              .withColumn("version", F.lit(version)) for version in (0, 1)]
    return (tables.table_history(spark, path)
            .select(F.col("version").cast("int").alias("version"), "operation")
            .join(reduce(DataFrame.unionByName, counts), "version"))


def quality_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = rel.load(spark, sf_dir, "orders")
    customers = rel.load(spark, sf_dir, "customer").withColumn(
        "c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return (check_not_null(orders, "orders", ["o_orderkey", "o_custkey"])
            .unionByName(check_not_null(customers, "customer", ["c_custkey", "c_mktsegment"])))


def quality_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (check_unique(rel.load(spark, sf_dir, "lineitem"), "lineitem",
                         ["l_orderkey", "l_partkey"])
            .unionByName(check_unique(rel.load(spark, sf_dir, "customer"), "customer",
                                      ["c_custkey"])))


# -- windows -----------------------------------------------------------------

def _windows(spark: SparkSession, sf_dir: str, length: str) -> DataFrame:
    return windows.window_counts_batch(
        rel.click_events(rel.load(spark, sf_dir, "events")), length)


def window_counts_1min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.naive(_windows(spark, sf_dir, "1 minute"))


def window_counts_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.naive(_windows(spark, sf_dir, "1 hour"))


def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.naive(revenue.event_pivot(_windows(spark, sf_dir, "1 hour"), EVENT_TYPES))


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[str, runlog.RunLog]:
    root = scratch_path(configure(spark), "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A stream reads folders; as a pattern the name stands for a file or a folder.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    windows.run_stream(windows.window_counts(rel.click_events(events)), f"{root}/gold",
                       f"{root}/checkpoint", log, "events", trigger=None)
    return f"{root}/gold", log


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = _streamed(spark, sf_dir)
    return rel.naive(tables.read_table(spark, path))


def stream_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, log = _streamed(spark, sf_dir)
    return (log.runs().groupBy("job_name", "job_type", "status")
            .agg(F.sum("rows_read").alias("rows_read"),
                 F.sum("rows_written").alias("rows_written")))


def stream_json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON files in four drops, the stream started again for each from its checkpoint.

    The last drop repeats the first day's events, whose windows are closed by then.
    """
    root = scratch_path(configure(spark), "stream-json")
    events = rel.load(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    payload = F.to_json(F.struct(
        F.monotonically_increasing_id().cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("session_id"), F.col("user_id").cast("string").alias("user_id"),
        "event_type", F.lit("/").alias("page"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("event_time"))).alias("value")
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    quarter = F.least(F.floor((F.col("ts").cast("double") - first.timestamp()) * 4
                              / max(1e-6, last.timestamp() - first.timestamp())), F.lit(3))
    for part in range(4):
        drop = events.filter(quarter == part)
        if part == 3:
            drop = drop.unionByName(events.filter(F.col("ts") < F.lit(first) + F.expr("interval 1 day")))
        drop.select(payload).write.mode("append").text(f"{root}/in")
        decoded = windows.decode_events(windows.file_events(spark, f"{root}/in"))
        windows.run_stream(windows.window_counts(decoded), f"{root}/gold", f"{root}/checkpoint", log,
                           "events", trigger=None)
    return rel.naive(tables.read_table(spark, f"{root}/gold"))


def stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of a stream that has ended: the closed ones, and those read from its state."""
    root = scratch_path(configure(spark), "flush")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    windows.run_stream(windows.window_counts(rel.click_events(events)), f"{root}/gold", f"{root}/checkpoint",
                       log, "events", trigger=None, flush=True)
    return rel.naive(tables.read_table(spark, f"{root}/gold"))


def stream_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a second, stopped by its deadline, then gone on from the checkpoint until nothing is left."""
    root = scratch_path(configure(spark), "timed")
    events = rel.load(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    span = max(1e-6, last.timestamp() - first.timestamp())
    piece = F.least(F.floor((F.col("ts").cast("double") - first.timestamp()) * 4 / span), F.lit(3))
    for part in range(4):  # one after the other: a file's age is its place
        (events.filter(piece == part).select("ts", "user_id", "event_type").coalesce(1)
         .write.mode("append").parquet(f"{root}/in"))
    source = (spark.readStream.schema("ts timestamp, user_id bigint, event_type string")
              .option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    log = runlog.RunLog(spark, f"{root}/runs", f"{root}/reads")
    for timeout, idle in ((4.0, None), (600.0, 3.0)):
        windows.run_stream(windows.window_counts(rel.click_events(source)), f"{root}/gold", f"{root}/checkpoint",
                           log, "events", trigger="1 second", timeout=timeout, idle=idle, flush=True)
    return rel.naive(tables.read_table(spark, f"{root}/gold"))


# -- run log -----------------------------------------------------------------

def run_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = runlog.current_runs(rel.run_log(rel.pipeline_runs(spark, sf_dir)))
    return rel.naive(folded.select("run_id", "job_name", "job_type", "status", "started_at",
                                   "ended_at", "duration_seconds", "error_message"))


def runs_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.naive(reports.runs_by_type(rel.pipeline_runs(spark, sf_dir), "streaming"))


def _as_of(runs: DataFrame):
    return runs.agg(F.max("ended_at")).scalar()


def top_cost_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Decimal costs add up to the same total in any order.
    runs = rel.pipeline_runs(spark, sf_dir).withColumn(
        "estimated_cost_usd", F.col("estimated_cost_usd").cast("decimal(18,8)"))
    return (reports.top_cost(runs, _as_of(runs))
            .withColumn("total_cost", F.col("total_cost").cast("decimal(28,8)")))


def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = rel.pipeline_runs(spark, sf_dir)
    return rel.naive(reports.recent_failures(runs, _as_of(runs)))


def unused_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.naive(wastage.unused_tables(rel.pipeline_runs(spark, sf_dir),
                                           rel.table_reads(spark, sf_dir)))


def _rounded(trend: DataFrame) -> DataFrame:
    return trend.select("job_name", "runtime_trend_ratio", *[
        F.round(name, 6).alias(name) for name in (
            "total_estimated_cost_usd", "avg_recent_duration", "avg_prior_duration")])


def runtime_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(wastage.runtime_trend(rel.pipeline_runs(spark, sf_dir)))


def runtime_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(wastage.runtime_regressions(
        wastage.runtime_trend(rel.pipeline_runs(spark, sf_dir))))


def duplicate_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = wastage.duplicate_schemas(rel.schema_catalog(spark, sf_dir))
    return pairs.select("table_a", "table_b", F.round("overlap", 6).alias("overlap"),
                        F.array_join("shared_columns", ",").alias("shared_columns"))


def _schema_overlaps(spark: SparkSession, sf_dir: str):
    return wastage.schema_overlaps(rel.schema_catalog(spark, sf_dir))


def schema_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table with its class of equal schemas and the number of tables it overlaps with."""
    return wastage.schema_classes(_schema_overlaps(spark, sf_dir))


def schema_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of schemas that overlap, with the pairs of tables behind them."""
    return wastage.class_pairs(_schema_overlaps(spark, sf_dir)).withColumn(
        "overlap", F.round("overlap", 6)).withColumn("shared_columns", F.array_join("shared_columns", ","))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wastage.wastage_report(rel.pipeline_runs(spark, sf_dir),
                                  rel.table_reads(spark, sf_dir),
                                  rel.schema_catalog(spark, sf_dir))


def wastage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


def wastage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wastage.report_totals(rel.pipeline_runs(spark, sf_dir), rel.table_reads(spark, sf_dir),
                                 rel.schema_catalog(spark, sf_dir))


def run_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.run_edges(rel.pipeline_runs(spark, sf_dir))


def dependency_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = lineage.dependency_reads(**rel.lineage_frames(spark, sf_dir), reader_job="dbt_run")
    return reads.groupBy("table_name", "reader_job").agg(F.count(F.lit(1)).alias("reads"))


def manifest_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads along the dependencies of a manifest file: a model for every supplier, on its nation's source."""
    path = scratch_path(configure(spark), "manifest")
    nation = F.concat(F.lit("source.p."), F.col("n_name"))
    model = F.struct(F.lit("silver").alias("schema"), F.col("s_name").alias("name"),
                     F.struct(F.array(nation).alias("nodes")).alias("depends_on"))
    suppliers = rel.load(spark, sf_dir, "supplier").join(
        rel.load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    name = F.concat(F.lit("model.p."), F.col("s_suppkey").cast("string"))
    # A manifest is one JSON document, of a size a compiler of models writes.
    nodes = suppliers.agg(F.map_from_entries(F.collect_list(F.struct(name, model))).alias("nodes"))
    sources = rel.load(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(
        F.struct(nation, F.struct(F.col("n_name").alias("name"))))).alias("sources"))
    nodes.join(sources).select(F.to_json(F.struct("nodes", "sources"))).coalesce(1).write.text(path)
    manifest = corpus.load_manifest(spark, path)
    reads = lineage.dependency_reads(
        lineage.manifest_edges(manifest), lineage.manifest_nodes(manifest), lineage.manifest_sources(manifest),
        rel.lineage_frames(spark, sf_dir)["locations"], models.JOB_NAME)
    return reads.groupBy("table_name", "reader_job").agg(F.count(F.lit(1)).alias("reads"))


# -- retrieval ---------------------------------------------------------------

def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as text files in a folder for each language, loaded again by name."""
    path = scratch_path(configure(spark), "corpus")
    (rel.load(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text"))
     .write.partitionBy("lang").option("maxRecordsPerFile", 1000).text(path))
    loaded = corpus.load_corpus(spark, path, "*.txt")
    return loaded.groupBy(F.regexp_extract("source", "/lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum(F.length("text").cast("long")).alias("chars"))



def chunk_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rel.documents(spark, sf_dir)
    return tx.explode_parts(docs.select("doc_id", tx.sliding(F.col("text")).alias("chunk")),
                            "chunk", "chunk_index")


def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rel.documents_md(spark, sf_dir)
    return tx.explode_parts(docs.select("doc_id", tx.blocks(F.col("text")).alias("block")),
                            "block", "block_index")


def chunk_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rel.documents_md(spark, sf_dir)
    return tx.explode_parts(docs.select("doc_id", tx.chunks(F.col("text")).alias("chunk")),
                            "chunk", "chunk_index")


def chunk_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks stored, then every third document shortened, some to nothing, and stored again."""
    path = scratch_path(spark, "chunks")
    docs = rel.documents(spark, sf_dir)
    shorter = docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, "").when(
        F.col("doc_id") % 3 == 0, F.left("text", F.lit(300))).otherwise(F.col("text")))
    for version in (docs, shorter):
        named = rel.with_markdown(version).select(
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"), "text")
        chunks = retrieval.embed(retrieval.chunk(named), dims=8)
        retrieval.store_upsert(spark, path, chunks, dims=8, sources=named)
    return tables.read_table(spark, path).select("metadata.source", "metadata.chunk_index", "text")


def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's id and metadata as JSON, as exported."""
    docs = rel.documents_md(spark, sf_dir).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"), "text")
    return retrieval.to_json_metadata(retrieval.chunk(docs)).select("id", "metadata")


def _letters(texts) -> np.ndarray:
    """A model for the embedding seam: how often each of eight letters occurs."""
    return np.array([[text.count(letter) for letter in "aeinorst"] for text in texts], dtype=np.float32).reshape(-1, 8)


def embed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded by a model that is passed in, as (doc_id, slot, value)."""
    vectors = retrieval.embed(rel.documents(spark, sf_dir), fn=_letters, dims=8)
    return vectors.select("doc_id", F.posexplode("embedding").alias("slot", "value")).select(
        "doc_id", F.col("slot").cast("long"), F.col("value").cast("long"))


def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts per hash slot of every document, as (doc_id, slot, words)."""
    docs = rel.documents(spark, sf_dir)
    vectors = retrieval.embed(docs, dims=EMBED_DIMS)
    slots = vectors.select("doc_id", F.posexplode("embedding").alias("slot", "words"))
    return slots.filter("words > 0").select("doc_id", F.col("slot").cast("long"), F.col("words").cast("long"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = rel.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    query = vectors.orderBy("id").first()["embedding"]  # one row
    return nearest_to(query, vectors, 5).select("id", F.round("score", 4).alias("score"))


def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth vector, the five nearest of all."""
    vectors = rel.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    return nearest(asked, vectors, 5).withColumn("score", F.round("score", 4))


def vector_topk_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a store that holds every vector twice: ties go to the lower id."""
    vectors = rel.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    twice = vectors.unionByName(vectors.withColumn("id", F.col("id") + 10_000_000))
    return nearest(asked, twice.repartition(7), 6).select("qid", "rank", "id")


def vector_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as of all pairs, from cells around pivots visited by their bounds."""
    vectors = rel.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    return pivots.search(pivots.build(vectors), asked, 5).withColumn("score", F.round("score", 4))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chunked, embedded and stored; every question's nearest chunks."""
    docs = rel.documents_md(spark, sf_dir).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"), "text")
    chunks = retrieval.embed(retrieval.chunk(docs), dims=EMBED_DIMS)
    path = scratch_path(spark, "chunks")
    retrieval.store_upsert(spark, path, chunks, dims=EMBED_DIMS)
    asked = rel.questions(spark, sf_dir).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("qid"), F.col("question").alias("text"))
    return retrieval.retrieve(asked, tables.read_table(spark, path), dims=EMBED_DIMS)


def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.context(_hits(spark, sf_dir))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.citations(_hits(spark, sf_dir))


def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.route(rel.questions(spark, sf_dir)).select(
        "conv_id", "turn", "question", "tool")


def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with its tool and the whole text it is answered from, documents among them."""
    # Decimal costs add up to the same total in any order.
    runs = rel.pipeline_runs(spark, sf_dir).withColumn(
        "estimated_cost_usd", F.col("estimated_cost_usd").cast("decimal(18,8)"))
    asked = rel.questions(spark, sf_dir).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), "question")
    docs = rel.documents_md(spark, sf_dir).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source"), "text")

    def store() -> DataFrame:
        path = scratch_path(spark, "chunks")
        retrieval.store_upsert(spark, path, retrieval.embed(retrieval.chunk(docs), dims=EMBED_DIMS), dims=EMBED_DIMS)
        return tables.read_table(spark, path)

    routed, found = questions.answers(asked, runs, rel.table_reads(spark, sf_dir), store, _as_of(runs), dims=EMBED_DIMS)
    return questions.contexts(routed, found)


QUERIES: dict[str, Query] = {query.__name__: query for query in (
    daily_revenue, revenue_by_day, revenue_by_region, latest_lineitem, latest_customer_order,
    sample_orders, bronze_ingest, incremental_ingest, incremental_files, quarantine_counts, csv_by_name,
    csv_options, load_stamps, model_run_log, model_schema_overlap, catalog_revenue, catalog_columns, failed_runs, read_log, upsert_orders, time_travel_counts, quality_not_null,
    quality_unique, window_counts_1min, window_counts_1h, event_pivot, stream_window_counts,
    stream_heartbeats, stream_json_counts, stream_flush, stream_timed, run_log_latest, runs_by_type, top_cost_jobs, recent_failures,
    unused_tables, runtime_trend, runtime_regressions, duplicate_schemas, schema_classes, schema_class_pairs, wastage_report,
    wastage_totals, run_edges, dependency_reads, manifest_reads, corpus_files, chunk_sliding, chunk_blocks, chunk_packed,
    chunk_replacement, chunk_metadata, embed_chunks, embed_model, vector_topk, vector_topk_batch,
    vector_topk_copies, vector_topk_pruned, retrieval_context, citations, route_questions, tool_answers,
)}
