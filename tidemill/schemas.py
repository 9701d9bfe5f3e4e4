"""Declared schemas of the tables the library owns or reads."""

from __future__ import annotations

from pyspark.sql import types as T

STRING_LIST = T.ArrayType(T.StringType())

ORDERS_RAW = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("order_amount", T.DoubleType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

CUSTOMERS_RAW = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("signup_date", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

CLICK_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("page", T.StringType()),
    T.StructField("event_time", T.StringType()),
])

PIPELINE_RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("rows_read", T.LongType()),
    T.StructField("rows_written", T.LongType()),
    T.StructField("bytes_scanned", T.LongType()),
    T.StructField("input_tables", STRING_LIST),
    T.StructField("output_tables", STRING_LIST),
    T.StructField("error_message", T.StringType()),
    T.StructField("estimated_cost_usd", T.DoubleType()),
])

# The run log is append-only; ``logged_at`` orders the entries of one run.
RUN_LOG = T.StructType(PIPELINE_RUNS.fields + [T.StructField("logged_at", T.TimestampType())])

TABLE_READS = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("read_at", T.TimestampType()),
    T.StructField("reader_job", T.StringType()),
])

# Where a named table lies and what its columns are; the newest row of a name counts.
TABLE_CATALOG = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("columns", STRING_LIST),
    T.StructField("recorded_at", T.TimestampType()),
])

CATALOG_COLUMNS = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
])

# Only the manifest members that lineage needs; Spark prunes the rest on read.
MANIFEST = T.StructType([
    T.StructField("nodes", T.MapType(T.StringType(), T.StructType([
        T.StructField("schema", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("depends_on", T.StructType([T.StructField("nodes", STRING_LIST)])),
    ]))),
    T.StructField("sources", T.MapType(T.StringType(), T.StructType([
        T.StructField("name", T.StringType()),
    ]))),
])
