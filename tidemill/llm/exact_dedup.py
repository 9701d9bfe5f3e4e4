"""Exact duplicates through counting quotient filters, confirmed byte by byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import parts_for, prepared, runs_of, stage, table

#: Fingerprints in one slice of the merged filter, about.
SLICE_ROWS = 500_000


def build_filter(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A counting quotient filter in sorted form: distinct fingerprints and their counts.

    A fingerprint's high bits are its quotient, its low bits the remainder; in
    ascending order the remainders of one quotient stand side by side.
    """
    values, counts = np.unique(prints, return_counts=True)
    return values, counts.astype(np.int64)


def merge_filters(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The filter of all the parts' fingerprints: sorted remainders merge, counts add up."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")  # runs of sorted parts: merges, mostly
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else []
    return values[first], np.add.reduceat(counts, first) if len(values) else counts


def pack_slice(values: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Quotients are held as run lengths, remainders in as few whole bytes as hold them."""
    rest = 64 - bits
    width = -(-rest // 8)
    remainders = values & np.uint64((1 << rest) - 1)
    packed = remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(packed).tobytes(), bytes([width])


def unpack_slice(quotient: int, bits: int, packed: bytes) -> np.ndarray:
    rest = 64 - bits
    width = -(-rest // 8)
    rows = np.frombuffer(packed, dtype=np.uint8).reshape(-1, width)
    wide = np.zeros((len(rows), 8), dtype=np.uint8)
    wide[:, :width] = rows
    return wide.view("<u8").reshape(-1) | np.uint64(quotient << rest)


def _slices(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(build_filter(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            # A filter merges with one no larger than twice it, so a fingerprint is copied few times.
            while len(held) > 1 and len(held[-2][0]) <= 2 * len(held[-1][0]):
                held[-2:] = [merge_filters(held[-2:])]
        values, counts = merge_filters(held)
        high = values >> np.uint64(64 - bits) if bits else np.zeros(len(values), np.uint64)
        at = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(high) else []
        edges = [*at, len(values)]
        rows = [(int(high[i]), pack_slice(values[i:j], bits)[0], counts[i:j].astype("<i8").tobytes())
                for i, j in zip(edges[:-1], edges[1:], strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary())], ["slice", "remainders", "counts"])
    return run


def _repeated(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, ["slice"]):
            part = group.column("slice")[0].as_py()
            values, counts = merge_filters([
                (unpack_slice(part, bits, r.as_py()), np.frombuffer(c.as_py(), dtype="<i8"))
                for r, c in zip(group.column("remainders"), group.column("counts"), strict=True)])
            more = counts > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[more].view(np.int64)), pa.array(counts[more])], ["print", "n"])
    return run


def repeated_prints(prints: DataFrame, rows: int) -> DataFrame:
    """(print, n): fingerprints of ``prints`` (one long column) that occur more than once.

    Every task builds the filter of its part; slices of a range of quotients
    meet in one task and merge. A fingerprint that a third of the rows share is
    one entry with a count in each part.
    """
    bits = min(20, max(0, (parts_for(rows, SLICE_ROWS) - 1).bit_length()) + 4)
    slices = prints.mapInArrow(_slices(bits), "slice long, remainders binary, counts binary")
    dealt = slices.repartition(F.col("slice")).sortWithinPartitions("slice")
    return dealt.mapInArrow(_repeated(bits), "print long, n long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, shas = [], []
        for text in batch.column("text").to_pylist():
            low = (text or "").encode().lower()
            prints.append(xxhash.xxh64_intdigest(low))
            shas.append(hashlib.sha256(low).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64)),
             pa.array(shas, pa.binary())], ["doc_id", "print", "sha"])


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lows = [(t or "").encode().lower() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"),
             pa.array(np.array([xxhash.xxh64_intdigest(x) for x in lows], np.uint64).view(np.int64)),
             pa.array(lows, pa.binary())], ["doc_id", "print", "low"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty,
    and empty texts are equal to each other. Of equal texts the row with the
    largest id stays; a null id loses to any other. Rows that repeat an id and
    its text are all reported, and kept together. Other columns are ignored,
    whatever their names. No rows give no rows.

    Fingerprints counted more than once by the merged quotient filters go on to
    comparison of the whole bytes, in a grouping by the text itself, which
    combines before it shuffles; the rest are known to be alone.
    """
    spark = prepared(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digests = stage(docs.mapInArrow(_digests, "doc_id long, print long, sha binary"), "digests")
    repeated = stage(repeated_prints(digests.select("print"), digests.count()), "repeated")
    same = (docs.mapInArrow(_normalised, "doc_id long, print long, low binary")
            .join(repeated.select("print"), "print", "left_semi")
            .groupBy("low").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    groups = same.filter("group_size > 1").select(
        F.unhex(F.sha2("low", 256)).alias("sha"), "keep_id", "group_size")
    alone = F.col("group_size").isNull()
    return digests.join(groups, "sha", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(low) AS text_sha256
FROM d WINDOW w AS (PARTITION BY low)
"""
