"""Short reports over the run log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _since(as_of: datetime | Column, days: int) -> Column:
    start = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.col("ended_at") >= start - F.lit(timedelta(days=days))


def top_cost(runs: DataFrame, as_of: datetime | Column, days: int = 7, n: int = 10) -> DataFrame:
    """The n jobs that cost most over the trailing days."""
    return (runs.filter((F.col("status") == "success") & _since(as_of, days))
            .groupBy("job_name").agg(F.sum("estimated_cost_usd").alias("total_cost"))
            .orderBy(F.desc_nulls_last("total_cost"), "job_name").limit(n))


def recent_failures(runs: DataFrame, as_of: datetime | Column, days: int = 3) -> DataFrame:
    """Failed runs of the trailing days, newest first."""
    return (runs.filter((F.col("status") == "failed") & _since(as_of, days))
            .select("job_name", "ended_at", "error_message")
            .orderBy(F.desc("ended_at"), "job_name", "error_message"))


def runs_by_type(runs: DataFrame, job_type: str) -> DataFrame:
    """Runs of one type in starting order."""
    return (runs.filter(F.col("job_type") == job_type)
            .select("job_name", "job_type", "status", "started_at", "rows_read", "rows_written")
            .orderBy(F.asc_nulls_last("started_at"), "job_name"))
