"""Text corpora and model manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import schemas


def load_corpus(spark: SparkSession, path: str, name_glob: str = "*") -> DataFrame:
    """One row (source, text) per file below ``path`` whose name matches ``name_glob``.

    Folders are searched recursively. Bytes that are not UTF-8 are dropped.
    """
    files = (spark.read.option("recursiveFileLookup", True)
             .option("pathGlobFilter", name_glob).text(path, wholetext=True))
    # Making a text valid turns undecodable bytes into U+FFFD, which is then removed. Such
    # characters of the text's own are set aside meanwhile, behind an escape.
    kept = F.replace(F.replace("value", F.lit("\x1a"), F.lit("\x1aa")), F.lit("\ufffd"), F.lit("\x1ab"))
    cleaned = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    cleaned = F.replace(F.replace(cleaned, F.lit("\x1ab"), F.lit("\ufffd")), F.lit("\x1aa"), F.lit("\x1a"))
    return files.select(
        F.col("_metadata.file_path").alias("source"),
        F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(cleaned).alias("text"))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The model manifest (nodes and sources maps) as one row."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
