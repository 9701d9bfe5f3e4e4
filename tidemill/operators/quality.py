"""Declared data checks: not-null and unique columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The checks declared for the lakehouse, as (check, table, column).
# Bronze repeats keys by design, so uniqueness is asked of silver only.
DECLARED = (
    ("not_null", "bronze.orders", "order_id"),
    ("not_null", "bronze.customers", "customer_id"),
    ("not_null", "silver.stg_customers", "customer_id"),
    ("unique", "silver.stg_customers", "customer_id"),
)


def check_not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Null count of every listed column, all in one scan."""
    counts = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    pairs = F.array(*[F.struct(F.lit(name).alias("column"), F.col(name).alias("failures"))
                      for name in columns])
    return counts.select(F.inline(pairs)).select(
        F.lit("not_null").alias("check"), F.lit(table).alias("table"), "column", "failures")


def check_unique(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Number of values occurring more than once, per listed column; nulls do not count.

    One scan and one shuffle count all whole-number columns, as (column, value).
    Values of other types are counted by their hash first; only those whose hash
    occurs again are compared themselves.
    """
    whole = [name for name in columns if isinstance(df.schema[name].dataType, T.IntegralType)]
    other = [name for name in columns if name not in whole]

    def entries(names: list[str], **values) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(columns.index(name)).alias("no"), *[make(name).alias(k) for k, make in values.items()])
            for name in names]))).filter("value is not null")

    counted = []
    if whole:
        counted.append(entries(whole, value=lambda name: F.col(name).cast("long")).groupBy("no", "value").count())
    if other:
        values = entries(other, value=lambda name: F.col(name).cast("string"), hash=lambda name: F.xxhash64(name))
        again = values.groupBy("no", "hash").count().filter("count > 1").select("no", "hash")
        counted.append(values.join(again, ["no", "hash"], "left_semi").groupBy("no", "value").count())
    failures = reduce(DataFrame.unionByName, [
        part.groupBy("no").agg(F.count_if(F.col("count") > 1).alias("failures")) for part in counted])
    wanted = df.sparkSession.createDataFrame(list(enumerate(columns)), "no int, column string")
    return wanted.join(F.broadcast(failures), "no", "left").select(  # a row for each listed column
        F.lit("unique").alias("check"), F.lit(table).alias("table"), "column",
        F.coalesce("failures", F.lit(0).cast("long")).alias("failures"))


def run_checks(frames: dict[str, DataFrame],
               declared: Sequence[tuple[str, str, str]] = DECLARED) -> DataFrame:
    """(check, table, column, failures) of every declared check; zero failures is a pass."""
    run = {"not_null": check_not_null, "unique": check_unique}
    columns: dict[tuple[str, str], list[str]] = {}
    for check, table, column in declared:
        columns.setdefault((check, table), []).append(column)
    return reduce(DataFrame.unionByName, [
        run[check](frames[table], table, names) for (check, table), names in columns.items()])
