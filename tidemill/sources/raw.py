"""Config-driven ingestion of raw JSON and CSV drops into bronze tables.

A load reads everything in a source's folder, or, as an incremental one, only
the files that no load has read before. By default the first value that can't be read
stops a load; a source with a quarantine keeps such rows there, with reason and file.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.plans.runlog import Run, RunLog
from tidemill.session import path_exists, scratch_path
from tidemill.sources import tables

# The formats, and the words of the errors on an unknown one or an empty folder.
FORMATS = ("json", "csv")
UNSUPPORTED = "Unsupported format: {}"
NO_FILES = "No {} files found under {}"
INGESTED_AT = "_ingested_at"

# Fixed value: how ingestion runs are named, before the source's name.
JOB_PREFIX = "autoloader_"

#: Files an incremental load reads in one step; their names come to the driver.
FILES_AT_ONCE = 1000
# What a parsed row says about itself until good and rejected ones part.
RECORD, REASON, FILE = "_record", "_reason", "_file"
_LISTED = "path string, modificationTime timestamp, length long, content binary"


@dataclass(frozen=True)
class SourceSpec:
    """One configured source. ``schema`` is a DDL string; without it types are inferred.

    ``quarantine`` is the folder for rows that don't fit the schema; it needs one. ``pattern`` says which
    files of the folder are the source's, those named after the format by default. ``slots`` is how
    many an incrementally loaded table is laid out in.
    """

    name: str
    format: str
    raw_path: str
    bronze_table: str
    primary_key: str | None = None
    incremental_column: str | None = None
    schema: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    quarantine: str | None = None
    pattern: str | None = None
    slots: int = tables.SLOTS

    @property
    def files(self) -> str:
        return self.pattern or f"*.{self.format}"

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(UNSUPPORTED.format(self.format))
        if self.quarantine and not self.schema:
            raise ValueError(f"{self.name} has a quarantine, but no schema to hold rows against")


def load_specs(config: str) -> list[SourceSpec]:
    """Source specs from a YAML file with a top-level ``sources`` list."""
    import yaml

    entries = yaml.safe_load(Path(config).read_text())["sources"]
    return [SourceSpec(**{**entry, "options": dict(entry.get("options") or {})})
            for entry in entries]


def _located(root: str, path: str) -> str:
    return path if "://" in path or path.startswith("/") else f"{root.rstrip('/')}/{path}"


def _require_files(spark: SparkSession, spec: SourceSpec, folder: str) -> None:
    """Raise unless the folder holds a file of the format; listing alone decides, no content is read."""
    there = path_exists(spark, folder) and not (
        spark.read.format("binaryFile").option("pathGlobFilter", spec.files).load(folder).select("path").isEmpty())
    if not there:
        raise FileNotFoundError(NO_FILES.format(spec.format, folder))


def _literal(path: str) -> str:
    """A file's path for a reader, which takes some characters for patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_raw(spark: SparkSession, spec: SourceSpec, root: str = "") -> DataFrame:
    """Every file of the source directly in its folder, stamped with one load time.

    Columns are matched by name; one a file lacks is null for its rows.
    """
    folder = _located(root, spec.raw_path)
    _require_files(spark, spec, folder)
    return _read(spark, spec, [folder])


def _read(spark: SparkSession, spec: SourceSpec, paths: Sequence[str]) -> DataFrame:
    """The rows of folders or files; what doesn't fit stops the load."""
    if spec.format == "json":
        reader = spark.read.options(**spec.options).option("pathGlobFilter", spec.files)
        if spec.schema:
            reader = reader.schema(spec.schema)
        # Malformed lines stop the load rather than turn into null rows.
        df = reader.option("mode", spec.options.get("mode", "FAILFAST")).json(list(paths))
    elif spec.options.get("header", "true").lower() != "true":
        reader = spark.read.options(**spec.options).option("pathGlobFilter", spec.files)
        typed = reader.schema(spec.schema) if spec.schema else reader.option("inferSchema", True)
        df = typed.csv(list(paths))
    else:
        df = _typed(spec, *_csv_cells(spark, spec, paths))
    return df.withColumn(INGESTED_AT, F.current_timestamp())


def _csv_headers(spark: SparkSession, spec: SourceSpec, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of every header: one line of each file comes to the driver."""
    lines = (spark.read.option("pathGlobFilter", spec.files).text(list(paths))
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("position")))
    first = (lines.filter((F.col("block") == 0) & (F.trim("value") != "")).groupBy("file")
             .agg(F.min_by("value", "position").alias("head")).orderBy("file"))
    sep = spec.options.get("sep", spec.options.get("delimiter", ","))
    found: dict[tuple[str, ...], list[str]] = {}
    for file, head in first.collect():
        [names] = csv.reader([head.removeprefix("\ufeff").rstrip("\r")], delimiter=sep, quotechar=spec.options.get("quote", '"'))
        if len(set(names)) < len(names):
            raise ValueError(f"{unquote(file)} repeats a column in its header")
        found.setdefault(tuple(names), []).append(unquote(file))
    return found


def _csv_cells(spark: SparkSession, spec: SourceSpec, paths: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The cells of all files as text, by name, and those names; REASON tells of rows with too many.

    Spark reads CSV by position, so the files of each header are read together under it.
    Cells a row lacks at its end are null. With ``multiLine`` cells may hold line breaks.
    """
    headers = _csv_headers(spark, spec, paths)
    names = sorted({name for header in headers for name in header})
    options = {k: v for k, v in spec.options.items() if k not in ("header", "mode", "inferSchema")}
    parts = []
    for header, files in headers.items():
        kinds = T.StructType([T.StructField(name, T.StringType()) for name in (*header, RECORD)])
        cells = (spark.read.options(**options).schema(kinds).option("header", True)
                 .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
                 .option("columnPruning", False).csv([_literal(file) for file in files]))
        # A row of another length than the header's; only a longer one has a cell behind the last.
        wider = ", ".join(f"c{i} string" for i in range(len(header) + 1))
        own = {k: v for k, v in options.items() if k in ("sep", "delimiter", "quote", "escape", "nullValue")}
        extra = F.from_csv(F.col(RECORD), wider, own)[f"c{len(header)}"]
        longer = F.when(F.col(RECORD).isNotNull() & extra.isNotNull(), F.lit("more cells than columns"))
        parts.append(cells.select(
            *[F.col(f"`{name}`") if name in header else F.lit(None).cast("string").alias(name) for name in names],
            RECORD, longer.alias(REASON), F.col("_metadata.file_path").alias(FILE)))
    if not parts:
        none = T.StructType([T.StructField(name, T.StringType()) for name in (RECORD, REASON, FILE)])
        return spark.createDataFrame([], none), []
    return reduce(DataFrame.unionByName, parts), names


def _typed(spec: SourceSpec, cells: DataFrame, names: list[str]) -> DataFrame:
    """The cells by type; one that doesn't fit, or a row with too many, stops the load."""
    if spec.schema:
        kinds = {f.name: f.dataType for f in T.StructType.fromDDL(spec.schema).fields}
    else:
        kinds = _inferred(cells, names)

    def typed(name: str) -> Column:
        value = F.col(f"`{name}`").cast(kinds[name]) if name in names else F.lit(None).cast(kinds[name])
        return F.when(F.col(REASON).isNull(), value).otherwise(F.raise_error(F.concat(
            F.col(REASON), F.lit(" in "), F.col(FILE), F.lit(": "), F.col(RECORD)))).alias(name)

    return cells.select(*[typed(name) for name in kinds])


def _inferred(cells: DataFrame, names: list[str]) -> dict[str, str]:
    """The narrowest type that all values of a column fit, in one scan for all columns."""
    order = ("bigint", "double", "date", "timestamp", "boolean")

    def fits(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        good = value.try_cast(kind).isNotNull()
        if kind == "date":  # a time of day must not get lost
            good = good & (F.length(value) == 10)
        return (F.count(value) > 0) & F.coalesce(F.bool_and(good | value.isNull()), F.lit(False))

    if not names:
        return {}
    seen = cells.agg(*[fits(name, kind).alias(f"{i}_{kind}")
                       for i, name in enumerate(names) for kind in order]).first()
    return {name: next((k for k in order if seen[f"{i}_{k}"]), "string") for i, name in enumerate(names)}


def parse_checked(spark: SparkSession, spec: SourceSpec, paths: Sequence[str]) -> DataFrame:
    """All rows by the spec's schema, with REASON (null: good), RECORD and FILE of each.

    A value that doesn't fit its column makes a row rejected and names the column; so do JSON that can't be
    parsed, more cells than a header has, and, where the spec declares one, a missing primary key.
    """
    fields = T.StructType.fromDDL(spec.schema).fields
    if spec.format == "json":
        kinds = T.StructType([*fields, T.StructField(RECORD, T.StringType())])
        rows = (spark.read.options(**spec.options).option("pathGlobFilter", spec.files).schema(kinds)
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).json(list(paths))
                .withColumn(FILE, F.col("_metadata.file_path")))
        odd = [F.when(F.col(RECORD).isNotNull() & F.col(f"`{f.name}`").isNull()
                      & F.get_json_object(RECORD, f"$['{f.name}']").isNotNull(),
                      F.lit(f"{f.name} is no {f.dataType.simpleString()}")) for f in fields]
        which = F.concat_ws(", ", *odd)
        reason = (F.when(F.col(RECORD).isNull(), F.lit(None))
                  .when(F.try_parse_json(RECORD).isNull() | (which == ""), "not a JSON object").otherwise(which))
        rows = rows.withColumn(REASON, reason)
    else:
        cells, names = _csv_cells(spark, spec, paths)
        given = [f for f in fields if f.name in names]
        odd = [F.when(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(),
                      F.lit(f"{f.name} is no {f.dataType.simpleString()}")) for f in given]
        which = F.nullif(F.concat_ws(", ", REASON, *odd), F.lit(""))
        line = F.coalesce(F.col(RECORD), F.to_csv(F.struct(*[F.col(f"`{name}`") for name in names]))
                          if names else F.lit(None).cast("string"))
        rows = cells.select(
            *[(F.col(f"`{f.name}`").try_cast(f.dataType) if f in given else F.lit(None).cast(f.dataType)).alias(f.name)
              for f in fields], line.alias(RECORD), which.alias(REASON), FILE)
    if spec.primary_key:
        keyless = F.when(F.col(f"`{spec.primary_key}`").isNull(), F.lit(f"{spec.primary_key} is missing"))
        rows = rows.withColumn(REASON, F.coalesce(REASON, keyless))
    return rows


def _counted(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """``df`` written to the scratch folder and read back, and its rows as the writing job counted them."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    rows = tables.write_counted(df, lambda w: w.partitionBy(*partition_by).parquet(path))["rows"]
    return spark.read.schema(df.schema).parquet(path), rows


def _parted(spark: SparkSession, spec: SourceSpec, paths: Sequence[str], folder: str,
            load: str) -> tuple[DataFrame, int]:
    """Good rows, and how many were read; rejected ones go to the quarantine. One parse, written once in two parts.

    ``load`` names the step: one that is repeated replaces what it left there.
    """
    names = [f.name for f in T.StructType.fromDDL(spec.schema).fields]
    parsed = parse_checked(spark, spec, paths).withColumn("_good", F.col(REASON).isNull())
    whole, rows = _counted(parsed, "parsed", ["_good"])
    (whole.filter("not _good")
     .select(F.lit(spec.name).alias("source"), F.col(FILE).alias("file"), F.col(REASON).alias("reason"),
             F.coalesce(RECORD, F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))).alias("record"),
             F.current_timestamp().alias("rejected_at"), F.lit(load).alias("load"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(folder))
    return whole.filter("_good").select(*[F.col(f"`{n}`") for n in names]).withColumn(
        INGESTED_AT, F.current_timestamp()), rows


QUARANTINE = ("source string, file string, reason string, record string, rejected_at timestamp, load string")


def read_quarantine(spark: SparkSession, spec: SourceSpec, root: str = "") -> DataFrame:
    """The rows a source's loads rejected: source, file, reason, record, rejected_at, load."""
    return tables.read_log(spark, _located(root, spec.quarantine), T.StructType.fromDDL(QUARANTINE))


def ingest(spark: SparkSession, spec: SourceSpec, run_log: RunLog, root: str = "",
           incremental: bool = False, files_at_once: int = FILES_AT_ONCE) -> DataFrame:
    """Load one source into its bronze table as one tracked run; returns the table.

    The default replaces the table by everything in the folder. With
    ``incremental`` only files that no load has read are, and their rows are merged by
    ``primary_key``; the one with the highest ``incremental_column`` stays.
    """
    target = _located(root, spec.bronze_table)
    with run_log.track(JOB_PREFIX + spec.name, "batch_ingestion", [spec.raw_path]) as run:
        folder = _located(root, spec.raw_path)
        _require_files(spark, spec, folder)
        if incremental:
            _load_new_files(spark, spec, root, folder, target, run, files_at_once)
        else:
            rows = (_parted(spark, spec, [folder], _located(root, spec.quarantine), run.run_id)[0]
                    if spec.quarantine else _read(spark, spec, [folder]))
            tables.write_snapshot(rows, target)
            run.rows_written = tables.rows_written(spark, target)
        run.output_tables = [target]
        schema = tables.table_schema(spark, target)
        if schema is not None:
            run_log.record_table(target, target, schema.fieldNames())
    return tables.read_table(spark, target, schema_if_missing=_declared(spec))


def _declared(spec: SourceSpec) -> T.StructType | None:
    """What a table would hold of which no row was good yet."""
    return T.StructType.fromDDL(f"{spec.schema}, {INGESTED_AT} timestamp") if spec.schema else None


def _load_new_files(spark: SparkSession, spec: SourceSpec, root: str, folder: str, target: str, run: Run,
                    files_at_once: int) -> None:
    """Merge the rows of files not read before; per key the row with the highest marker stays.

    A streaming file source lists the folder and keeps, in its checkpoint beside the table, which
    files were read; each step of it reads its files as a batch. A step that failed is repeated with the
    same files, and merging them again changes nothing: equal markers are told
    apart by the rows' content, so neither the order of loads matters. Rows without a key are
    told apart by content too. A file is known by its path; one that is written over isn't read again.
    """
    if not (spec.primary_key and spec.incremental_column):
        raise ValueError(f"{spec.name} declares no primary_key and incremental_column")
    run.rows_read = run.rows_written = 0

    def step(batch: DataFrame, batch_id: int) -> None:
        # At most ``files_at_once`` names; one with characters of patterns is listed twice.
        files = sorted({_literal(row[0]) for row in batch.collect()})
        if not files:
            return
        if spec.quarantine:
            read, rows = _parted(spark, spec, files, _located(root, spec.quarantine), f"{spec.name}-{batch_id}")
        else:
            read, rows = _counted(_read(spark, spec, files), "files")
        content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(set(read.columns) - {INGESTED_AT})]),
                                   {"ignoreNullFields": "false"}), 256)
        key = F.col(f"`{spec.primary_key}`")
        order = [F.desc_nulls_last(spec.incremental_column), content.desc(), F.col(INGESTED_AT)]
        before = tables.newest_version(spark, target)
        after = tables.merge_latest(spark, target, read, [key, F.when(key.isNull(), content)], order,
                                    tables.hashed([f"`{spec.primary_key}`"], spec.slots))
        run.rows_read += rows
        run.rows_written += tables.rows_written(spark, target) if after != before else 0

    listed = (spark.readStream.format("binaryFile").schema(_LISTED)
              .option("pathGlobFilter", spec.files).option("maxFilesPerTrigger", files_at_once)
              .option("maxFileAge", "36500d")  # an old file that arrives late is new all the same
              .load(folder).select("path"))
    query = (listed.writeStream.foreachBatch(step).option("checkpointLocation", f"{target}_files")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def ingest_one(spark: SparkSession, specs: list[SourceSpec], name: str, run_log: RunLog,
               root: str = "") -> DataFrame:
    """Load a single source by its configured name."""
    by_name = {spec.name: spec for spec in specs}
    return ingest(spark, by_name[name], run_log, root)


def ingest_all(spark: SparkSession, specs: list[SourceSpec], run_log: RunLog,
               root: str = "") -> dict[str, DataFrame]:
    """Load every configured source in order; stops at the first that fails."""
    return {spec.name: ingest(spark, spec, run_log, root) for spec in specs}
