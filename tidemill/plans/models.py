"""The transform step: silver views and gold tables in the session's catalog, as tracked runs.

Layers are databases. A view is stored as SQL over the relations of the layer before; a table's files
are a new version below the lake, and its catalog entry reads them. So any session on
the catalog reads ``silver.stg_orders`` or ``gold.daily_revenue`` by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.plans import revenue
from tidemill.plans.runlog import RunLog
from tidemill.session import local_rows
from tidemill.sources import tables

VIEW, TABLE = "view", "table"

# The name and type of a transform run.
JOB_NAME, JOB_TYPE = "dbt_run", "dbt"


@dataclass(frozen=True)
class Model:
    """A named relation: what it reads and how it is built from that; a view has its SQL."""

    layer: str
    name: str
    kind: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame] | None = None
    sql: str | None = None

    @property
    def full_name(self) -> str:
        return f"{self.layer}.{self.name}"


MODELS = (
    Model("silver", "stg_orders", VIEW, ("bronze.orders",), sql=revenue.STG_ORDERS_SQL),
    Model("silver", "stg_customers", VIEW, ("bronze.customers",), sql=revenue.STG_CUSTOMERS_SQL),
    Model("gold", "daily_revenue", TABLE, ("silver.stg_orders", "silver.stg_customers"),
          build=revenue.daily_revenue),
)


def register(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Make a table folder's newest version known as ``database.table``; its files aren't touched.

    The entry is a view over the version's files: other sessions look it up anew for each
    query, where they would keep a table's old place until they refresh it.
    """
    columns = ", ".join(f"`{column}`" for column in tables.table_schema(spark, path).fieldNames())
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.partition('.')[0]}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM parquet.`{tables.table_location(spark, path)}`")
    return spark.table(name)


def table_columns(spark: SparkSession, databases: Sequence[str] = ("silver", "gold")) -> DataFrame:
    """(table_name, column_name, data_type) of all relations of the databases, from the catalog alone."""
    rows = [dict(table_name=f"{database}.{table.name}", column_name=column.name, data_type=column.dataType)
            for database in databases if spark.catalog.databaseExists(database)
            for table in spark.catalog.listTables(database) if not table.isTemporary
            for column in spark.catalog.listColumns(f"{database}.{table.name}")]
    return local_rows(spark, rows, schemas.CATALOG_COLUMNS)


def run_models(spark: SparkSession, bronze: dict[str, str], lake: str, run_log: RunLog,
               models: Sequence[Model] = MODELS, job_name: str = JOB_NAME,
               count_views: bool = True) -> dict[str, DataFrame]:
    """Build models in order; views are stored lazily, tables become new versions below ``lake``.

    ``bronze`` maps source names to table paths. Views are known as
    ``<layer>.<name>``, and to this session as ``<layer>_<name>``. The run records the rows of all relations
    built, the bronze tables read and the reads along model dependencies. A view that a table
    is built from is counted while that is written; one that no table reads is run to
    be counted, unless ``count_views`` is off and only rows of tables are recorded.
    """
    built: dict[str, DataFrame] = {
        f"bronze.{name}": register(spark, f"bronze.{name}", path) for name, path in bronze.items()}
    places = {f"bronze.{name}": path for name, path in bronze.items()}
    read = {name for model in models for name in model.inputs}
    declared = [places[name] for name in places if name in read]
    counts: dict[str, Observation] = {}  # of views, as the tables built from them saw them
    used: set[str] = set()
    results: dict[str, DataFrame] = {}
    with run_log.track(job_name, JOB_TYPE, declared) as run:
        run.rows_written = 0
        for model in models:
            name = model.full_name
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {model.layer}")
            if model.kind == VIEW:
                spark.sql(f"CREATE OR REPLACE VIEW {name} AS {model.sql.format(bronze='bronze')}")
                df = spark.table(name)
                df.createOrReplaceTempView(f"{model.layer}_{model.name}")
                counts[name] = Observation()
                built[name] = df.observe(counts[name], F.count(F.lit(1)).alias("rows")) if count_views else df
                run_log.record_table(name, None, df.columns)
            else:
                used.update(model.inputs)
                frames = [built[i] if i in built else _earlier(spark, i, lake) for i in model.inputs]
                path = f"{lake}/{model.layer}/{model.name}"
                tables.write_snapshot(model.build(*frames), path)
                run.rows_written += tables.rows_written(spark, path)
                df = built[name] = register(spark, name, path)
                run_log.record_table(name, path, df.columns)
            results[name] = df
        if count_views:
            for name, seen in counts.items():
                found = tables.observed(seen) if name in used else None
                run.rows_written += results[name].count() if found is None else found["rows"]
        run.output_tables = [model.full_name for model in models]
    now = datetime.now(timezone.utc)
    edges = [dict(table_name=places.get(name, name), read_at=now, reader_job=job_name)
             for model in models for name in model.inputs]
    run_log.record_reads(local_rows(spark, edges, schemas.TABLE_READS))
    return results


def _earlier(spark: SparkSession, name: str, lake: str) -> DataFrame:
    """An input built by an earlier run: by its name in the catalog, or its table."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    layer, _, short = name.partition(".")
    return tables.read_table(spark, f"{lake}/{layer}/{short}")
