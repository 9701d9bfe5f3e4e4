"""Lineage: edges of the run log and table reads derived from a model manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.lookup import salted_join


def run_edges(runs: DataFrame) -> DataFrame:
    """The edges a run implies: input table -> job and job -> output table."""
    inward = runs.select(F.explode("input_tables").alias("from_node"),
                         F.col("job_name").alias("to_node"))
    outward = runs.select(F.col("job_name").alias("from_node"),
                          F.explode("output_tables").alias("to_node"))
    return inward.union(outward).distinct()


def manifest_nodes(manifest: DataFrame) -> DataFrame:
    """(node_id, table_name) of every model; a model's table is schema.name."""
    return (manifest.select(F.explode("nodes").alias("node_id", "node"))
            .select("node_id", F.concat_ws(".", "node.schema", "node.name").alias("table_name")))


def manifest_sources(manifest: DataFrame) -> DataFrame:
    """(node_id, source_name) of every declared source."""
    return (manifest.select(F.explode("sources").alias("node_id", "source"))
            .select("node_id", F.col("source.name").alias("source_name")))


def manifest_edges(manifest: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(model_id, node_id) dependencies, of all models or of those just run."""
    nodes = manifest.select(F.explode("nodes").alias("model_id", "node"))
    if models is not None:
        nodes = nodes.filter(F.col("model_id").isin(models))
    return nodes.select("model_id", F.explode("node.depends_on.nodes").alias("node_id"))


def dependency_reads(edges: DataFrame, nodes: DataFrame, sources: DataFrame,
                     locations: DataFrame, reader_job: str) -> DataFrame:
    """One table read per dependency edge.

    A ``model.`` dependency reads the model's table, a ``source.`` one the
    location of its source; other kinds, and sources without a location, read
    nothing. ``locations`` holds (source_name, location).
    """
    models = nodes.select("node_id", "table_name")
    located = (sources.join(locations, "source_name")
               .select("node_id", F.col("location").alias("table_name")))
    known = (models.filter(F.col("node_id").startswith("model."))
             .union(located.filter(F.col("node_id").startswith("source."))))
    # One source may be behind a large share of the edges.
    return (salted_join(edges, known, "node_id", "model_id", "inner").filter(F.col("table_name").isNotNull())
            .select("table_name", F.current_timestamp().alias("read_at"),
                    F.lit(reader_job).alias("reader_job")))
