"""Silver frames and the gold revenue aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.dedupe import latest_by_key
from tidemill.operators.lookup import salted_join


def stg_orders(bronze: DataFrame) -> DataFrame:
    """Typed orders, the latest row per order.

    Rows equal in ``updated_at`` are ordered by their other columns, so a
    rerun keeps the same one. Ranking follows the cast timestamp.
    """
    typed = bronze.select(
        "order_id", "customer_id",
        F.col("order_amount").cast("decimal(10,2)").alias("order_amount"),
        F.col("order_status").cast("string").alias("order_status"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        F.col("updated_at").cast("timestamp").alias("updated_at"),
    )
    order = [F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"),
             "order_status", "order_amount", "customer_id"]
    return latest_by_key(typed, ["order_id"], order)


def stg_customers(bronze: DataFrame) -> DataFrame:
    """Typed customers, the latest row per customer."""
    typed = bronze.select(
        "customer_id",
        F.col("email").cast("string").alias("email"),
        F.col("signup_date").cast("date").alias("signup_date"),
        F.col("region").cast("string").alias("region"),
        F.col("updated_at").cast("timestamp").alias("updated_at"),
    )
    order = [F.desc_nulls_last("updated_at"), F.desc_nulls_last("signup_date"), "email", "region"]
    return latest_by_key(typed, ["customer_id"], order)


#: The same two as SQL over tables of a catalog, for views that outlast a session.
STG_ORDERS_SQL = """
SELECT order_id, customer_id, order_amount, order_status, created_at, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC NULLS LAST,
    created_at DESC NULLS LAST, order_status, order_amount, customer_id) AS place
  FROM (SELECT order_id, customer_id, CAST(order_amount AS DECIMAL(10,2)) AS order_amount,
               CAST(order_status AS STRING) AS order_status, CAST(created_at AS TIMESTAMP) AS created_at,
               CAST(updated_at AS TIMESTAMP) AS updated_at FROM {bronze}.orders))
WHERE place = 1
"""
STG_CUSTOMERS_SQL = """
SELECT customer_id, email, signup_date, region, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY updated_at DESC NULLS LAST,
    signup_date DESC NULLS LAST, email, region) AS place
  FROM (SELECT customer_id, CAST(email AS STRING) AS email, CAST(signup_date AS DATE) AS signup_date,
               CAST(region AS STRING) AS region, CAST(updated_at AS TIMESTAMP) AS updated_at
        FROM {bronze}.customers))
WHERE place = 1
"""


def daily_revenue(orders: DataFrame, customers: DataFrame, status: str = "completed") -> DataFrame:
    """Order count and revenue per day and region of the orders in one status.

    Orders without a customer form the null region. A customer may own a large
    share of the orders, so its orders are spread over tasks for the join; the
    sums are combined map-side before their shuffle.
    """
    kept = orders.filter(F.col("order_status") == status).select(
        "order_id", "customer_id", "order_amount",
        F.date_trunc("day", "created_at").alias("order_date"))
    regions = customers.select("customer_id", "region")
    return (salted_join(kept, regions, "customer_id", "order_id")
            .groupBy("order_date", "region")
            .agg(F.count("order_id").alias("order_count"),
                 F.sum("order_amount").alias("total_revenue")))


def revenue_by_day(gold: DataFrame) -> DataFrame:
    return (gold.groupBy("order_date").agg(F.sum("total_revenue").alias("total_revenue"))
            .orderBy(F.asc_nulls_last("order_date")))


def revenue_by_region(gold: DataFrame) -> DataFrame:
    """Revenue per known region, highest first."""
    return (gold.filter(F.col("region").isNotNull()).groupBy("region")
            .agg(F.sum("total_revenue").alias("total_revenue"))
            .orderBy(F.desc("total_revenue"), "region"))


def event_pivot(windows: DataFrame, event_types: list[str]) -> DataFrame:
    """Mean event count per window start (rows) and event type (columns), gaps as 0.

    The column values are given, so no extra job looks them up; a type that is not
    among them stops the query rather than vanish from the answer.
    """
    known = F.col("event_type").isNull() | F.col("event_type").isin(event_types)
    windows = windows.withColumn("event_type", F.when(known, F.col("event_type")).otherwise(
        F.raise_error(F.concat(F.lit("event type without a column: "), F.col("event_type")))))
    return (windows.groupBy("window_start").pivot("event_type", event_types)
            .agg(F.avg("event_count")).na.fill(0.0, event_types)
            .orderBy("window_start"))


def sample(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first n rows by a key, for a look at a table."""
    return df.orderBy(F.asc_nulls_last(key)).limit(n)
