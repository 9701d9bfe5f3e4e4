"""Session defaults, the shared scratch folder, and ways to lay out intermediate data."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Runtime SQL settings every plan in this library relies on or benefits from.
# Cluster sizing (executors, memory, shuffle partitions) stays with the caller.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Whether an execution deletes its shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime SQL settings to an existing session."""
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "tidemill", cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Rebalancing then leaves as many parts as there are cores on small inputs too.
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "true")
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session, so every executor sees
    the folder; a session without it uses its warehouse, shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_rows(spark: SparkSession, rows: Sequence[dict], schema: T.StructType) -> DataFrame:
    """A handful of driver-made rows as one partition, without starting Python workers."""
    return spark.createDataFrame(
        pa.Table.from_pylist(list(rows), schema=to_arrow_schema(schema)), schema)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the scratch folder and read it back.

    For a result several later steps start from: it is computed once, its
    lineage ends in files that outlive any executor, and the planner knows
    its size. What its job shuffled is deleted with the job, not when the driver
    happens to collect garbage: nothing reads it again.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, by its own file system; starts no job."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever its file system is; nothing happens if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(scan: DataFrame) -> DataFrame:
    """Even out a scan before heavy work per row; Spark chooses the parts by their size."""
    return scan.hint("rebalance")
