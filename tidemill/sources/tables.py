"""Parquet tables: full refresh as whole versions, keyed changes by partition overwrite.

Layout of a table folder::

    data/<token>/...     one snapshot, or the slots of a keyed table (``_slot=<value>/``)
    current/             one JSON row: the newest version and where its rows lie
    history/             one JSON row per version

A full refresh writes a new snapshot; older ones stay readable. A keyed change
on a table with slots reads and rewrites the slots its rows fall into, with
Spark's dynamic partition overwrite, and leaves the others as they are; it replaces the version
before. Without slots a keyed change is one join and a new snapshot, which suits small
tables. A version is published by its row, after its data. One writer at a
time is expected: one that finds another version than it began with fails.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.dedupe import latest_by_key
from tidemill.session import drop_folder, local_rows, path_exists, scratch_path

RECORD = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("committed_at", T.TimestampType()),
    T.StructField("operation", T.StringType()),
    T.StructField("rows_written", T.LongType()),
    T.StructField("folder", T.StringType()),
    T.StructField("slot", T.StringType()),
    T.StructField("schema_json", T.StringType()),
])

SLOT = "_slot"  # the column a keyed table is partitioned by
GONE = "_gone"  # marks rows that say their group has no row any more
NEW = "_new"    # marks the source's rows among those that stay
SLOTS = 16      # slots by hash; a large table wants one for each GB or so, as a change rewrites whole slots


def hashed(keys: Sequence[str], slots: int = SLOTS) -> str:
    """The slot of a row by the hash of its keys, as SQL; all slots are alike in size."""
    return f"pmod(xxhash64({', '.join(keys)}), {slots})"


def observed(seen: Observation, patience: float = 10.0) -> dict | None:
    """What an observation saw in an action that has ended; None if the planner had dropped its place."""
    found: list[dict] = []
    waiting = threading.Thread(target=lambda: found.append(seen.get), daemon=True)
    waiting.start()
    waiting.join(patience)
    return found[0] if found else None


def write_counted(df: DataFrame, save: Callable[[DataFrameWriter], None], **counts: Column) -> dict[str, int]:
    """Write ``df`` and return the aggregates asked for, and ``rows``, taken in the writing job itself.

    They sit right below the write, so a task that is retried, or run twice, counts once.
    """
    seen = Observation()
    wanted = {"rows": F.count(F.lit(1)), **counts}
    save(df.observe(seen, *[column.alias(name) for name, column in wanted.items()]).write)
    return {name: seen.get[name] for name in wanted}


def _records(spark: SparkSession, folder: str) -> DataFrame | None:
    return spark.read.schema(RECORD).json(folder) if path_exists(spark, folder) else None


def _record(spark: SparkSession, path: str, version: int | None = None) -> Row | None:
    """The record of a version or the newest one, which is one small file however long the history."""
    if version is None:
        current = _records(spark, f"{path}/current")
        row = None if current is None else current.first()
        if row is not None:
            return row
    history = _records(spark, f"{path}/history")  # the pointer is being replaced, or a writer died at it
    if history is None:
        return None
    if version is not None:
        history = history.filter(F.col("version") == version)
    return history.orderBy(F.desc("version")).first()


def _publish(spark: SparkSession, path: str, previous: Row | None, operation: str, rows: int,
             folder: str, slot: str | None, schema: T.StructType) -> int:
    begun, now = previous and previous["version"], _record(spark, path)
    if (now and now["version"]) != begun:
        raise ValueError(f"another writer has published version {now['version']} of {path}")
    version = 0 if previous is None else begun + 1
    row = dict(version=version, committed_at=datetime.now(timezone.utc), operation=operation, rows_written=rows,
               folder=folder, slot=slot, schema_json=schema.json())
    record = local_rows(spark, [row], RECORD)
    record.write.mode("append").json(f"{path}/history")
    record.write.mode("overwrite").json(f"{path}/current")
    return version


def _schema_of(record: Row) -> T.StructType:
    return T.StructType.fromJson(json.loads(record["schema_json"]))


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return sorted((field.name, field.dataType.simpleString()) for field in schema.fields)


def _rows(spark: SparkSession, path: str, record: Row) -> DataFrame:
    """The rows of a version; those of a table with slots name theirs, for pruning."""
    schema = _schema_of(record)
    if record["slot"]:
        schema = T.StructType(schema.fields + [T.StructField(SLOT, T.StringType())])
    return spark.read.schema(schema).parquet(f"{path}/{record['folder']}")


def newest_version(spark: SparkSession, path: str) -> int | None:
    record = _record(spark, path)
    return None if record is None else record["version"]


def table_exists(spark: SparkSession, path: str) -> bool:
    return _record(spark, path) is not None


def table_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Column names and types without touching data; None if there is no table."""
    record = _record(spark, path)
    return None if record is None else _schema_of(record)


def table_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per published version."""
    records = _records(spark, f"{path}/history")
    if records is None:
        records = spark.createDataFrame([], RECORD)
    return records.select("version", "committed_at", "operation", "rows_written")


def table_location(spark: SparkSession, path: str) -> str | None:
    """The folder the latest version's files lie in, for readers that take plain Parquet."""
    record = _record(spark, path)
    return None if record is None else f"{path}/{record['folder']}"


def has_slots(spark: SparkSession, path: str) -> bool:
    record = _record(spark, path)
    return record is not None and record["slot"] is not None


def read_table(spark: SparkSession, path: str, version: int | None = None,
               schema_if_missing: T.StructType | None = None) -> DataFrame:
    """The latest version of a table, or the version asked for."""
    record = _record(spark, path, version)
    if record is None:
        if schema_if_missing is not None and version is None:
            return spark.createDataFrame([], schema_if_missing)
        wanted = "" if version is None else f" at version {version}"
        raise FileNotFoundError(f"No table found under {path}{wanted}")
    if version is not None and record["slot"] and newest_version(spark, path) != version:
        raise ValueError(f"version {version} of {path} was overwritten by slots")
    return _rows(spark, path, record).drop(SLOT)


def register_views(spark: SparkSession, locations: dict[str, str]) -> None:
    """Make tables available to SQL under their logical names."""
    for name, path in locations.items():
        read_table(spark, path).createOrReplaceTempView(name)


def _folder() -> str:
    return f"data/{uuid.uuid4().hex}"


def write_snapshot(df: DataFrame, path: str, allow_evolution: bool = False,
                   partition_by: Sequence[str] = ()) -> int:
    """Replace the table's content by ``df`` as a new version; older ones stay readable."""
    spark = df.sparkSession
    previous = _record(spark, path)
    if previous is not None and not allow_evolution:
        before, after = _shape(_schema_of(previous)), _shape(df.schema)
        if before != after:
            raise ValueError(f"schema of {path} would change from {before} to {after}")
    folder = _folder()
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    counts = write_counted(df, lambda w: w.partitionBy(*partition_by).parquet(f"{path}/{folder}"))
    return _publish(spark, path, previous, "overwrite", counts["rows"], folder, None, df.schema)


def rows_written(spark: SparkSession, path: str) -> int:
    """Rows the latest version wrote."""
    record = _record(spark, path)
    return 0 if record is None else record["rows_written"]


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append to a plain parquet folder (logs that only ever grow)."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An append-only folder, or an empty relation of its schema before the first append."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def without_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``old`` whose keys no row of ``new`` has; a null key matches nothing."""
    names = [f"_key{i}" for i in range(len(keys))]
    there = new.select(*[F.col(key).alias(name) for key, name in zip(keys, names, strict=True)])
    keyed = old.withColumns(dict(zip(names, map(F.col, keys), strict=True)))
    return keyed.join(there, names, "left_anti").drop(*names)


def upsert(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str],
           slot: str | None = None) -> int | None:
    """Replace rows whose keys match, insert the others; returns the new version.

    Keys must be unique in the source; a null key matches nothing. An empty
    source changes nothing. ``slot`` is SQL over the keys (``hashed``, or a day of
    a time) and makes a table whose changes touch its slots only; a
    table with slots keeps them, and one without is laid out anew when given some.
    """
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        return without_keys(old, new, keys).unionByName(new)

    def unique(new: DataFrame) -> None:
        whole = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
        twice = new.filter(whole).groupBy(*[F.col(key) for key in keys]).count().filter("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"source repeats a key of {list(keys)}")

    return _merge(spark, path, source, slot, combine, unique)


def merge_latest(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str | Column],
                 order: Sequence[Column | str], slot: str | None = None) -> int | None:
    """Of the table's and the source's rows of a key keep the first in ``order``; returns the new version.

    Merging the same rows again, or in another sequence, gives the same table, so a load
    that is repeated after a failure does no harm. Null keys are a key like any other. The version's
    rows written are those of the source that stay.
    """
    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn(NEW, F.lit(False)).unionByName(new.withColumn(NEW, F.lit(True)))
        return latest_by_key(both, list(keys), list(order))

    return _merge(spark, path, source, slot, combine)


def replace_groups(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str],
                   emptied: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
                   slot: str | None = None) -> int | None:
    """Replace all rows of every group (same keys) the source has rows of; returns the new version.

    ``emptied`` holds, in the table's columns, one row for each group that has no rows any
    more; only its keys count. A function is given the source's rows, as staged, to find them from: so
    the source isn't computed for that again.
    """
    if emptied is not None:
        source = source.withColumn(GONE, F.lit(False))
    if isinstance(emptied, DataFrame):
        source = source.unionByName(emptied.withColumn(GONE, F.lit(True)))
    later = emptied if callable(emptied) else None

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        groups = [side.select(*[F.col(key).alias(f"_group{i}") for i, key in enumerate(keys)]).distinct()
                  for side in (old, new)]
        # Where every group is replaced, as when a corpus is stored again, the old rows needn't move.
        stay = not without_keys(*groups, groups[0].columns).isEmpty()
        kept = without_keys(old, new, keys) if stay else old.filter(F.lit(False))
        return kept.unionByName(new if emptied is None else new.filter(~F.col(GONE)).drop(GONE))

    return _merge(spark, path, source, slot, combine, later=later)


def _merge(spark: SparkSession, path: str, source: DataFrame, slot: str | None,
           combine: Callable[[DataFrame, DataFrame], DataFrame],
           check: Callable[[DataFrame], None] | None = None,
           later: Callable[[DataFrame], DataFrame] | None = None) -> int | None:
    """Stage the source, combine it with the old rows of its slots, and overwrite those.

    ``later`` makes rows of groups that are gone from those staged.
    """
    previous = _record(spark, path)
    marks = [GONE] if GONE in source.columns else []
    shape = T.StructType([field for field in source.schema.fields if field.name not in marks])
    schema = shape if previous is None else _schema_of(previous)
    if _shape(schema) != _shape(shape):
        raise ValueError(f"source of {path} has {_shape(shape)}, table {_shape(schema)}")
    laid_out = previous["slot"] if previous is not None else None
    if slot and laid_out and slot != laid_out:
        raise ValueError(f"{path} has slots by {laid_out}, not {slot}")
    slot = slot or laid_out
    names = schema.fieldNames()
    place = F.expr(slot).cast("string") if slot else None
    # Written once and read back, so that the source is computed once and outlives its executors.
    source = source.select(*[F.col(f"`{name}`") for name in names + marks])
    staged = scratch_path(spark, "merge")
    keyed = source.withColumn(SLOT, place) if slot else source
    rows = write_counted(keyed, lambda w: w.option("compression", "zstd").parquet(staged))["rows"]
    if later:
        gone = later(spark.read.schema(keyed.schema).parquet(staged)).withColumn(GONE, F.lit(True))
        gone = gone.withColumn(SLOT, place) if slot else gone
        rows += write_counted(gone.select(*keyed.columns), lambda w: w.mode("append").option("compression", "zstd").parquet(staged))["rows"]
    if not rows:
        return previous and previous["version"]
    new = spark.read.schema(keyed.schema).parquet(staged)
    if check:
        check(new)
    folder, old = _folder(), spark.createDataFrame([], schema)
    touched: list[str] = []
    if previous is not None:
        old = _rows(spark, path, previous)
    if laid_out:
        folder = previous["folder"]
        # At most as many values as the table has slots; the others aren't read.
        touched = [row[0] for row in new.select(SLOT).distinct().collect()]
        old = old.filter(F.col(SLOT).isin([value for value in touched if value is not None])
                         | (F.col(SLOT).isNull() if None in touched else F.lit(False)))
    elif slot:
        old = old.withColumn(SLOT, place)
    merged = combine(old, new)
    empty = _emptied(merged, new, touched) if marks and laid_out else []
    if slot:
        merged = merged.hint("rebalance", SLOT)
    marked, seen = NEW in merged.columns, Observation()
    if marked:
        merged = merged.observe(seen, F.count_if(NEW).alias("stay"))
    out = merged.select(*[F.col(f"`{name}`") for name in names], *([SLOT] if slot else []))
    if slot:
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy(SLOT).parquet(f"{path}/{folder}"))
    else:
        out.write.parquet(f"{path}/{folder}")
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for value in empty:  # an overwrite leaves a slot alone that it has no rows for
        drop_folder(spark, f"{path}/{folder}/{SLOT}={escaped(value)}")
    if marked:
        rows = seen.get["stay"]
    return _publish(spark, path, previous, "upsert", rows, folder, slot, schema)


def _emptied(merged: DataFrame, new: DataFrame, touched: Sequence[str]) -> list[str]:
    """Of the touched slots those that will have no row; only slots without new rows are looked into."""
    filled = {row[0] for row in new.filter(~F.col(GONE)).select(SLOT).distinct().collect()}
    open_ = [value for value in touched if value not in filled]
    if not open_:
        return []
    left = {row[0] for row in merged.filter(F.col(SLOT).isin(open_)).select(SLOT).distinct().collect()}
    return [value for value in open_ if value not in left]
