"""Findings over the run log: unused tables, runtime trends, duplicate schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.overlap import Overlaps, overlaps

# Thresholds of the report.
RUNTIME_TREND_THRESHOLD = 1.2
SCHEMA_OVERLAP_THRESHOLD = 0.5

# Section titles of the report.
UNUSED_TITLE = "Unused tables"
TREND_TITLE = "Rising cost / runtime trend"
SCHEMAS_TITLE = "Near-duplicate output schemas"


def _succeeded() -> Column:
    return F.col("status") == "success"


def _by_name(tables_seen: DataFrame, catalog: DataFrame) -> DataFrame:
    """``table_name`` by its catalog name where it is a location of one."""
    place = F.regexp_replace(F.rtrim(F.col("location"), F.lit("/")), "^file:/+", "/")
    names = (catalog.filter("location is not null and location <> table_name")
             .groupBy(place.alias("_place")).agg(F.min("table_name").alias("_name")))
    seen = F.regexp_replace(F.rtrim(F.col("table_name"), F.lit("/")), "^file:/+", "/")
    return (tables_seen.join(names, seen == F.col("_place"), "left")
            .withColumn("table_name", F.coalesce("_name", "table_name")).drop("_name", "_place"))


def unused_tables(runs: DataFrame, reads: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Tables written by successful runs that no run of any status and no reader read.

    Both sides are reduced to one row per table before they meet. With a
    ``catalog`` a table is one whether it was named or given by its location.
    """
    written = (runs.filter(_succeeded())
               .select(F.explode("output_tables").alias("table_name"), "ended_at")
               .groupBy("table_name").agg(F.max("ended_at").alias("last_written")))
    read = (runs.select(F.explode("input_tables").alias("table_name"))
            .union(reads.select("table_name")).distinct())
    if catalog is not None:
        written = (_by_name(written, catalog).groupBy("table_name")
                   .agg(F.max("last_written").alias("last_written")))
        read = _by_name(read, catalog)
    return (written.join(read, "table_name", "left_anti")
            .orderBy(F.desc_nulls_last("last_written"), "table_name"))


def runtime_trend(runs: DataFrame, recent: int = 5, prior: int = 5) -> DataFrame:
    """Mean duration of each job's last runs against the runs before, and its total cost.

    The means need the newest ``recent + prior`` runs only; ranking keeps that
    many per job and map task, so a job owning a third of the log never meets
    in one task. Total cost is a plain sum, combined map-side.
    """
    done = runs.filter(_succeeded())
    newest = Window.partitionBy("job_name").orderBy(F.desc_nulls_last("ended_at"), "run_id")
    rank = F.col("recency_rank")
    means = (
        done.select("job_name", "run_id", "ended_at", "duration_seconds")
        .withColumn("recency_rank", F.row_number().over(newest))
        .filter(rank <= recent + prior)
        .groupBy("job_name")
        .agg(F.avg(F.when(rank <= recent, F.col("duration_seconds"))).alias("avg_recent_duration"),
             F.avg(F.when(rank > recent, F.col("duration_seconds"))).alias("avg_prior_duration"))
    )
    cost = done.groupBy("job_name").agg(
        F.sum("estimated_cost_usd").alias("total_estimated_cost_usd"))
    ratio = F.col("avg_recent_duration") / F.nullif(F.col("avg_prior_duration"), F.lit(0.0))
    # A null job name never matches its cost, as in a plain equi-join.
    return (means.join(cost, "job_name", "left")
            .select("job_name", "total_estimated_cost_usd", "avg_recent_duration",
                    "avg_prior_duration", F.round(ratio, 2).alias("runtime_trend_ratio"))
            .orderBy(F.desc_nulls_last("runtime_trend_ratio"), "job_name"))


def runtime_regressions(trend: DataFrame, threshold: float = RUNTIME_TREND_THRESHOLD) -> DataFrame:
    """Jobs whose rounded ratio reaches the threshold; a missing ratio never does."""
    return trend.filter(F.col("runtime_trend_ratio") >= threshold)


def output_columns(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(table_name, column_name) of every output table of the runs that the catalog knows.

    A join of names; no data and no table is opened.
    """
    names = _by_name(runs.select(F.explode("output_tables").alias("table_name")).distinct(), catalog)
    return (catalog.join(names.distinct(), "table_name", "left_semi")
            .select("table_name", F.explode("columns").alias("column_name")))


def schema_overlaps(columns: DataFrame, threshold: float = SCHEMA_OVERLAP_THRESHOLD) -> Overlaps:
    """Tables with equal columns as classes, and the classes that share enough of theirs."""
    return overlaps(columns.select(F.col("table_name").alias("name"), F.col("column_name").alias("member")), threshold)


def schema_classes(found: Overlaps) -> DataFrame:
    """(table_name, class, tables, links) of every table: its class, by the least name, and the tables it overlaps with."""
    return found.members().toDF("table_name", "class", "tables", "links")


def class_pairs(found: Overlaps) -> DataFrame:
    """Pairs of classes that overlap, with how many tables and pairs of tables are behind each."""
    return found.pairs().toDF("table_a", "table_b", "tables_a", "tables_b", "pairs", "overlap", "shared_columns")


def duplicate_schemas(columns: DataFrame,
                      threshold: float = SCHEMA_OVERLAP_THRESHOLD) -> DataFrame:
    """Pairs of tables sharing at least ``threshold`` of their columns; copies give all their pairs."""
    return schema_overlaps(columns, threshold).expanded().toDF("table_a", "table_b", "overlap", "shared_columns")


def _finding(check: str, finding: Column, reason: Column) -> list[Column]:
    return [F.lit(check).alias("check"), finding.alias("finding"), reason.alias("reason")]


def _instant(at: Column) -> Column:
    """Date, time and offset; microseconds only where there are any."""
    whole = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    exact = F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat(F.when(F.date_trunc("second", at) == at, whole).otherwise(exact),
                    F.lit("+00:00"))


# The sentences of the reasons below.
def unused_findings(unused: DataFrame) -> DataFrame:
    reason = F.format_string(
        "written by a pipeline (last: %s) but never read as an input by any other tracked run",
        _instant(F.col("last_written")))
    return unused.select(*_finding(UNUSED_TITLE, F.col("table_name"), reason))


def trend_findings(trend: DataFrame, threshold: float = RUNTIME_TREND_THRESHOLD) -> DataFrame:
    percent = F.bround((F.col("runtime_trend_ratio") - 1) * 100, 0).cast("int")
    reason = F.format_string(
        "runtime trending up: recent runs average %.2fs vs %.2fs before (%+d%%), "
        "total est. cost so far $%.4f",
        "avg_recent_duration", "avg_prior_duration", percent, "total_estimated_cost_usd")
    return runtime_regressions(trend, threshold).select(
        *_finding(TREND_TITLE, F.col("job_name"), reason))


def schema_findings(pairs: DataFrame) -> DataFrame:
    percent = F.bround(F.col("overlap") * 100, 0).cast("int")
    shared = F.array_join(F.transform(
        "shared_columns", lambda name: F.concat(F.lit("'"), name, F.lit("'"))), ", ")
    reason = F.format_string(
        "%d%% of columns overlap ([%s]) -- possible redundant pipelines", percent, shared)
    return pairs.select(*_finding(
        SCHEMAS_TITLE, F.concat_ws(" <-> ", "table_a", "table_b"), reason))


def wastage_report(runs: DataFrame, reads: DataFrame, columns: DataFrame,
                   catalog: DataFrame | None = None) -> DataFrame:
    """All findings, labelled by check."""
    return (unused_findings(unused_tables(runs, reads, catalog))
            .unionByName(trend_findings(runtime_trend(runs)))
            .unionByName(schema_findings(duplicate_schemas(columns))))


def report_totals(runs: DataFrame, reads: DataFrame, columns: DataFrame,
                  catalog: DataFrame | None = None) -> DataFrame:
    """Findings per check and, with a null check, overall; pairs of tables are counted by class, not made."""
    def counted(check: str, value: Column, rows: DataFrame) -> DataFrame:
        return rows.agg(F.coalesce(value, F.lit(0).cast("long")).alias("findings")).select(
            F.lit(check).alias("check"), "findings")

    each = (counted(UNUSED_TITLE, F.count(F.lit(1)), unused_tables(runs, reads, catalog))
            .unionByName(counted(TREND_TITLE, F.count(F.lit(1)), runtime_regressions(runtime_trend(runs))))
            .unionByName(counted(SCHEMAS_TITLE, F.max("pairs"), schema_overlaps(columns).total())))
    return each.filter("findings > 0").rollup("check").agg(F.coalesce(F.sum("findings"), F.lit(0).cast("long")).alias("findings"))


def findings_total(findings: DataFrame) -> DataFrame:
    """Findings per check and, with a null check, overall."""
    return findings.rollup("check").agg(F.count(F.lit(1)).alias("findings"))
