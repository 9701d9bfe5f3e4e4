"""What several operators of the package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.session import configure, stage

BATCH_ROWS = 512


def prepared(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, since one row may hold a very long text."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition sorted by ``keys``, one at a time.

    Holds one group in memory, across batch borders.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        row_keys = list(zip(*columns, strict=True))
        begin = 0
        for i, key in enumerate(row_keys):
            if key != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, key
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[list[list]]:
    """The values of every group of a partition sorted by ``keys`` (whole numbers), as lists.

    Lighter than ``runs_of`` for many small groups.
    """
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in columns:
            changes |= column[1:] != column[:-1]
        edges = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        lists = [batch.column(v).to_pylist() for v in values]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(column[begin] for column in columns)
            if key == last:
                for own, more in zip(held, lists, strict=True):
                    own.extend(more[begin:end])
            else:
                if held:
                    yield held
                last, held = key, [x[begin:end] for x in lists]
    if held:
        yield held


def parts_for(rows: int, per_part: int) -> int:
    """How many parts hold ``rows`` with about ``per_part`` each; grows with the rows."""
    return max(1, -(-rows // per_part))


__all__ = ["BATCH_ROWS", "groups_of", "parts_for", "prepared", "runs_of", "stage", "table"]
