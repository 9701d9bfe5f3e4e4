"""The library's input relations, derived from the test tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.plans.runlog import cost_proxy, duration_seconds
from tidemill.session import configure, spread


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, with zone-less timestamps read as UTC instants."""
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name)
                       if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
                       for f in df.schema.fields])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, on all cores even where they come as one small file."""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text"))


def naive(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the comparison expects them."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
                       for f in df.schema.fields])


def bronze_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("order_amount"), F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


def bronze_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers; those of one market segment have no region."""
    customers = load(spark, sf_dir, "customer")
    nations = load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    day = F.lit("2024-01-01")
    return customers.join(nations, "c_nationkey").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("email"),
        day.alias("signup_date"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("region")).alias("region"), day.alias("updated_at"))


def click_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("ts").cast("timestamp").alias("event_time"), "event_type",
                         F.col("user_id").alias("session_id"))


def _seconds(value: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), value.cast("decimal(18,6)"))


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order."""
    orders = load(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = F.col("status")
    took = key % 900 + 30
    base = orders.withColumn(
        "status", F.when(F.col("o_orderstatus") == "F", "success")
        .when(F.col("o_orderstatus") == "P", "failed").otherwise("running"))
    started = F.col("o_orderdate") + _seconds(key % 86400)
    ended = started + _seconds(took)
    seconds = duration_seconds(started, ended)
    table = lambda n: F.concat(F.lit("tbl_"), n.cast("string"))
    done = status == "success"
    return base.select(
        F.concat(F.lit("run_"), key.cast("string")).alias("run_id"),
        F.concat(F.lit("job_"), (cust % 50).cast("string")).alias("job_name"),
        F.when(cust % 3 == 0, "batch_ingestion").when(cust % 3 == 1, "streaming")
        .otherwise("dbt").alias("job_type"),
        "status", started.alias("started_at"),
        F.when(status != "running", ended).alias("ended_at"),
        F.when(done, seconds).alias("duration_seconds"),
        F.lit(None).cast("bigint").alias("rows_read"),
        F.when(done, key).alias("rows_written"),
        F.lit(None).cast("bigint").alias("bytes_scanned"),
        F.array(table(cust % 45)).alias("input_tables"),
        F.when(done, F.array(table(cust % 60), table(cust % 60 + 1)))
        .otherwise(F.array().cast("array<string>")).alias("output_tables"),
        F.when(status == "failed", F.concat(F.lit("error "), (key % 7).cast("string")))
        .alias("error_message"),
        F.when(done, cost_proxy(seconds)).alias("estimated_cost_usd"))


def run_log(runs: DataFrame) -> DataFrame:
    """The entries that leave these runs: one at the start, one at the end."""
    opened = (runs.withColumn("status", F.lit("running"))
              .withColumns({name: F.lit(None).cast(runs.schema[name].dataType) for name in (
                  "ended_at", "duration_seconds", "rows_written", "error_message",
                  "estimated_cost_usd")})
              .withColumn("output_tables", F.array().cast("array<string>"))
              .withColumn("logged_at", F.col("started_at")))
    closed = runs.filter("status <> 'running'").withColumn("logged_at", F.col("ended_at"))
    return opened.unionByName(closed)


def table_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read per event; of views from one dashboard, of others from an export job."""
    user = F.col("user_id")
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("tbl_"), (user % 7 + 50).cast("string")).alias("table_name"),
        F.col("ts").alias("read_at"),
        F.concat(F.when(F.col("event_type") == "view", "dash_").otherwise("export_"), (user % 3).cast("string"))
        .alias("reader_job"))


def schema_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with one table per order, its columns named by the order's parts.

    Every table also has the load stamp, the column found everywhere.
    """
    # Not spread: lines of a table that lie together meet before the shuffle.
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = F.concat(F.lit("p_"), F.col("l_partkey").cast("string"))
    return lines.select(
        F.concat(F.lit("ord_"), F.col("l_orderkey").cast("string")).alias("table_name"),
        F.explode(F.array(part, F.lit("_ingested_at"))).alias("column_name"))


def documents_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some have blank lines and some table rows."""
    return with_markdown(documents(spark, sf_dir))


def with_markdown(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    marked = (F.when(F.col("doc_id") % 3 == 0, F.replace(text, F.lit("\n"), F.lit("\n\n")))
              .when(F.col("doc_id") % 3 == 1, F.replace(text, F.lit("\n"), F.lit("\n| ")))
              .otherwise(text))
    return docs.select("doc_id", marked.alias("text"))


# A question per remainder of the conversation number.
QUESTIONS = {
    0: "Which jobs COST most? ",
    1: "Why did it fail? ",
    2: "Which tables are unused? ",
    3: "What is getting slow? ",
    4: "Tell me about ",
}


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user turns of the conversations, each led by a question."""
    lead = F.lit("")
    for remainder, words in QUESTIONS.items():
        lead = F.when(F.col("conv_id") % 5 == remainder, words).otherwise(lead)
    return load(spark, sf_dir, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", F.concat(lead, F.col("text")).alias("question"))


def lineage_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A dependency graph: models are orders, their dependencies the suppliers of their lines."""
    supp = F.col("l_suppkey")
    kind = (F.when(supp % 3 == 0, F.concat(F.lit("model.supp_"), supp.cast("string")))
            .when(supp % 3 == 1, F.concat(F.lit("source.nation_"), (supp % 25).cast("string")))
            .otherwise(F.concat(F.lit("macro.x_"), supp.cast("string"))))
    nations = load(spark, sf_dir, "nation")
    return {
        "edges": load(spark, sf_dir, "lineitem").select(
            F.concat(F.lit("model.m_"), F.col("l_orderkey").cast("string")).alias("model_id"),
            kind.alias("node_id")),
        "nodes": load(spark, sf_dir, "supplier").select(
            F.concat(F.lit("model.supp_"), F.col("s_suppkey").cast("string")).alias("node_id"),
            F.concat_ws(".", F.lit("silver"), "s_name").alias("table_name")),
        "sources": nations.select(
            F.concat(F.lit("source.nation_"), F.col("n_nationkey").cast("string"))
            .alias("node_id"), F.col("n_name").alias("source_name")),
        "locations": nations.select(
            F.col("n_name").alias("source_name"),
            F.when(F.col("n_regionkey") != 0, F.concat(F.lit("/lake/bronze/"), F.col("n_name")))
            .alias("location")),
    }
