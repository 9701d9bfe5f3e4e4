"""Run log: every job's start, end or failure, and which tables were read.

The logs are append-only folders. A run is written once when it starts and
once when it ends; ``current_runs`` folds the log to one row per run, which
is what updating the row in place would show, without rewriting a table.
``compact`` folds the entries into a snapshot and starts a new generation of
entries; readers take the snapshot and what came after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import schemas
from tidemill.operators.dedupe import latest_by_key
from tidemill.session import local_rows
from tidemill.sources import tables

# Fixed value: nominal price of an hour's run, the stand-in for a real bill.
HOURLY_RATE_USD = 0.20


def duration_seconds(started: Column, ended: Column) -> Column:
    return ended.cast("double") - started.cast("double")


def cost_proxy(duration: Column, supplied: Column | None = None) -> Column:
    """Duration at the nominal hourly rate, unless a cost was supplied."""
    estimate = duration * F.lit(HOURLY_RATE_USD) / F.lit(3600)
    return estimate if supplied is None else F.coalesce(supplied, estimate)


@dataclass
class Run:
    """One job run; the fields below ``input_tables`` are filled in by the job."""

    run_id: str
    job_name: str
    job_type: str
    started_at: datetime
    input_tables: list[str]
    rows_read: int | None = None
    rows_written: int | None = None
    bytes_scanned: int | None = None
    output_tables: list[str] = field(default_factory=list)
    estimated_cost_usd: float | None = None


def _now() -> datetime:
    return datetime.now(timezone.utc)


ENTRIES = T.StructType(schemas.RUN_LOG.fields + [T.StructField("generation", T.LongType())])


class RunLog:
    """The run log, the read log and the catalog of named tables."""

    def __init__(self, spark: SparkSession, runs_path: str, reads_path: str) -> None:
        self.spark = spark
        self.runs_path = runs_path
        self.reads_path = reads_path
        self.snapshot_path = f"{runs_path.rstrip('/')}_snapshot"
        self.catalog_path = f"{reads_path.rstrip('/')}_catalog"

    def _generation(self) -> int:
        """Entries are appended under the number of snapshots there are."""
        version = tables.newest_version(self.spark, self.snapshot_path)
        return 0 if version is None else version + 1

    def _append(self, rows: Sequence[dict]) -> None:
        stamped = [{**row, "logged_at": _now(), "generation": self._generation()} for row in rows]
        tables.append_rows(local_rows(self.spark, stamped, ENTRIES),
                           self.runs_path, ["generation", "job_type"])

    def start(self, job_name: str, job_type: str, input_tables: Sequence[str] = ()) -> Run:
        run = Run(str(uuid.uuid4()), job_name, job_type, _now(), list(input_tables))
        self._append([dict(run_id=run.run_id, job_name=job_name, job_type=job_type,
                           status="running", started_at=run.started_at,
                           input_tables=run.input_tables, output_tables=[])])
        return run

    def end(self, run: Run, status: str = "success") -> None:
        self.end_all([(run, _now())], status)

    def end_all(self, runs: Sequence[tuple[Run, datetime]], status: str = "success") -> None:
        """Close several runs with one append (a stream's heartbeats)."""
        rows = []
        for run, ended_at in runs:
            seconds = (ended_at - run.started_at).total_seconds()
            cost = run.estimated_cost_usd
            rows.append(dict(
                run_id=run.run_id, job_name=run.job_name, job_type=run.job_type, status=status,
                started_at=run.started_at, ended_at=ended_at, duration_seconds=seconds,
                rows_read=run.rows_read, rows_written=run.rows_written,
                bytes_scanned=run.bytes_scanned, input_tables=run.input_tables,
                output_tables=run.output_tables,
                estimated_cost_usd=seconds * HOURLY_RATE_USD / 3600 if cost is None else cost))
        self._append(rows)

    def fail(self, job_name: str, error: str, run: Run | None = None) -> None:
        """Record a failure; without a run it gets an id of its own and an unknown type."""
        run = run or Run(str(uuid.uuid4()), job_name, "unknown", _now(), [])
        self._append([dict(run_id=run.run_id, job_name=job_name, job_type=run.job_type,
                           status="failed", started_at=run.started_at, ended_at=_now(),
                           input_tables=run.input_tables, output_tables=[],
                           error_message=error)])

    @contextmanager
    def track(self, job_name: str, job_type: str,
              input_tables: Sequence[str] = ()) -> Iterator[Run]:
        """Log a run around a block; an error is logged on the same run and raised again."""
        run = self.start(job_name, job_type, input_tables)
        try:
            yield run
        except Exception as error:
            self.fail(job_name, str(error), run)
            raise
        self.end(run)

    def record_read(self, table_name: str, reader_job: str) -> None:
        row = dict(table_name=table_name, read_at=_now(), reader_job=reader_job)
        self.record_reads(local_rows(self.spark, [row], schemas.TABLE_READS))

    def record_reads(self, reads: DataFrame) -> None:
        """Append rows of the read-log schema, laid out by day."""
        dated = reads.withColumn("read_date", F.to_date("read_at"))
        tables.append_rows(dated, self.reads_path, ["read_date"])

    def record_table(self, table_name: str, location: str | None, columns: Sequence[str]) -> None:
        """Note under which name a table is known, where it lies (None for a view) and its columns."""
        row = dict(table_name=table_name, location=location, columns=list(columns), recorded_at=_now())
        tables.append_rows(local_rows(self.spark, [row], schemas.TABLE_CATALOG), self.catalog_path)

    def catalog(self) -> DataFrame:
        """The newest record of every name."""
        log = tables.read_log(self.spark, self.catalog_path, schemas.TABLE_CATALOG)
        return latest_by_key(log, ["table_name"], [F.desc("recorded_at"), "location"])

    def _log(self, job_type: str | None = None) -> DataFrame:
        """The snapshot's entries and those since; of one type, reading only that type's files.

        The generation the snapshot was taken in is read again, for entries
        appended meanwhile; folding makes the repetition harmless.
        """
        version = tables.newest_version(self.spark, self.snapshot_path)
        log = tables.read_log(self.spark, self.runs_path, ENTRIES)
        if version is not None:
            log = log.filter(F.col("generation") >= version)
        log = log.select(*schemas.RUN_LOG.fieldNames())
        if version is not None:
            log = log.unionByName(tables.read_table(self.spark, self.snapshot_path))
        return log if job_type is None else log.filter(F.col("job_type") == job_type)

    def runs(self, job_type: str | None = None) -> DataFrame:
        """One row per run, as it stands now; a run never changes its type."""
        return current_runs(self._log(job_type)).select(*schemas.PIPELINE_RUNS.fieldNames())

    def reads(self) -> DataFrame:
        """The read log; empty with its columns when nothing was recorded yet."""
        layout = T.StructType(schemas.TABLE_READS.fields
                              + [T.StructField("read_date", T.DateType())])
        return (tables.read_log(self.spark, self.reads_path, layout)
                .select(*schemas.TABLE_READS.fieldNames()))

    def compact(self) -> int:
        """Fold the log so far into a snapshot, one entry per run, that readers start from."""
        return tables.write_snapshot(current_runs(self._log()), self.snapshot_path,
                                     partition_by=["job_type"])


def current_runs(log: DataFrame) -> DataFrame:
    """The last entry of every run; a closing entry wins over the opening one."""
    order = [F.expr("status = 'running'").asc(), F.desc_nulls_last("logged_at"),
             F.desc_nulls_last("ended_at")]
    return latest_by_key(log, ["run_id"], order)
