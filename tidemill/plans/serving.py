"""Gold tables as a dashboard loads them: ordered, and logged as read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.plans.runlog import RunLog
from tidemill.sources import tables


def load_gold(spark: SparkSession, path: str, order_by: Sequence[str], run_log: RunLog,
              reader_job: str, schema: T.StructType, name: str | None = None) -> DataFrame:
    """The latest rows in order; an empty frame, and no read logged, before the first build.

    The read is logged under ``name``, or under the name the catalog has for the place.
    """
    if not tables.table_exists(spark, path):
        return spark.createDataFrame([], schema)
    known = None if name else run_log.catalog().filter(
        (F.col("location") == path) & (F.col("table_name") != path)).select("table_name").first()
    run_log.record_read(name or (known[0] if known else path), reader_job)
    return tables.read_table(spark, path).orderBy(*[F.asc_nulls_last(c) for c in order_by])
