"""Plans when one key owns most of the rows."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators.dedupe import latest_by_key
from tidemill.operators.lookup import salted_join
from tidemill.plans import revenue


@pytest.fixture
def tight(spark):
    """Nothing is broadcast and a few kilobytes count as a skewed partition."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot_orders(spark):
    """60,000 orders of which two thirds belong to customer 0."""
    return spark.range(60_000, numPartitions=8).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 500).otherwise(0).alias("customer_id"),
        F.lit(1.5).alias("order_amount"), F.lit("completed").alias("order_status"),
        F.lit("2024-01-01").alias("created_at"),
        F.concat(F.lit("2024-01-0"), (F.col("id") % 9 + 1).cast("string")).alias("updated_at"))


def customers(spark):
    return spark.range(500).select(
        F.col("id").alias("customer_id"), F.lit("e").alias("email"),
        F.lit("2024-01-01").alias("signup_date"),
        F.when(F.col("id") == 0, "hot").otherwise("cold").alias("region"),
        F.lit("2024-01-01").alias("updated_at"))


def test_hot_customer_is_split(tight, rows):
    orders, people = revenue.stg_orders(hot_orders(tight)), revenue.stg_customers(customers(tight))
    gold = revenue.daily_revenue(orders, people)
    plan = final_plan(gold)
    assert "SortMergeJoin(skew=true)" in plan and "BroadcastHashJoin" not in plan
    plain = (orders.join(people, "customer_id", "left").groupBy("region")
             .agg(F.count("order_id"), F.sum("order_amount")))
    assert rows(gold.select("region", "order_count", "total_revenue"), "region") == \
        rows(plain, "region")


def test_dedupe_limits_a_hot_key_before_the_shuffle(tight):
    latest = latest_by_key(hot_orders(tight), ["customer_id"], [F.desc("updated_at"), "order_id"])
    assert latest.filter("customer_id = 0").first()["order_id"] == 8
    text = latest._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit [customer_id" in below and "Partial" in below


def test_salted_join_equals_plain_join(spark, rows):
    left = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(100)], "r long, k long")
    right = spark.createDataFrame([(k, v) for k in range(5) for v in "ab"], "k long, v string")
    for how in ("left", "inner"):
        assert rows(salted_join(left, right, "k", "r", how).select("r", "k", "v"), "r", "v") == \
            rows(left.join(right, "k", how).select("r", "k", "v"), "r", "v")
    with pytest.raises(ValueError):
        salted_join(left, right, "k", "r", "full")
