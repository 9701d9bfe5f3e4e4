"""Packing documents into token sequences in a controlled mixture of sources."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.llm.common import parts_for, prepared, runs_of, stage, table

#: Tokens in a sequence; sequences one turn of the round robin fills; turns one task packs.
LENGTH, TURN, TURNS = 2048, 16, 128
#: A document may be cut after any multiple of so many of its tokens.
STEP = 8
#: Documents of a source whose places in its queue one task counts.
QUEUE_ROWS = 5_000
END = 1
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@cache
def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def _encoders(path: str):
    """A fast encoder with the file's vocabulary, and the file's own tokenizer."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i
             for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return fast, Tokenizer.from_file(path)


_LONG_SPACE = re.compile(r"\s{2000}")


def encode(text: str, path: str) -> np.ndarray:
    """The ids of the text, as the tokenizer file gives them without special tokens."""
    fast, own = _encoders(path)
    if _LONG_SPACE.search(text):  # the fast encoder's pattern backtracks over long blanks
        return np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")


def checkpoints(ids: np.ndarray) -> np.ndarray:
    """The CRC-32 of the ids before every STEP-th one, and of all of them."""
    raw, crc, out = ids.tobytes(), 0, [0]
    for at in range(0, len(raw), 4 * STEP):
        crc = zlib.crc32(raw[at:at + 4 * STEP], crc)
        out.append(crc)
    return np.array(out, dtype="<u4")


def _times(matrix: list[int], vector: int) -> int:
    out, row = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[row]
        vector >>= 1
        row += 1
    return out


@cache
def _zeros(nbytes: int) -> tuple[int, ...]:
    """What appending so many zero bytes does to each bit of a CRC-32 (a GF(2) matrix)."""
    if nbytes == 1:
        out = []
        for bit in range(32):
            crc = 1 << bit
            for _ in range(8):
                crc = (crc >> 1) ^ (0xEDB88320 if crc & 1 else 0)
            out.append(crc)
        return tuple(out)
    half = _zeros(nbytes // 2)
    double = [_times(half, column) for column in half]
    return tuple(double) if nbytes % 2 == 0 else tuple(_times(_zeros(1), column) for column in double)


def crc_between(before: int, after: int, nbytes: int) -> int:
    """The CRC-32 of the last ``nbytes`` bytes, from those of the whole and of what precedes."""
    return after ^ _times(_zeros(nbytes), before) if nbytes else 0


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, marks = [], []
            for text in batch.column("text").to_pylist():
                ids = np.append(encode(text or "", path), np.uint32(END)).astype("<u4")
                counts.append(len(ids))
                marks.append(checkpoints(ids).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64()),
                 pa.array(marks, pa.binary())], ["doc_id", "source", "n", "marks"])
    return run


def cut(rows: Iterator[tuple], length: int = LENGTH) -> Iterator[tuple]:
    """Fill sequences with (doc_id, n, marks) in turn; yields the pieces.

    A document that doesn't fit is cut after the last multiple of STEP tokens
    that does; what remains of a sequence then (under STEP tokens) is padding.
    """
    sequence, used = 0, 0
    for doc_id, n, marks in rows:
        crcs = struct.unpack(f"<{len(marks) // 4}I", marks)
        start = 0
        while start < n:
            room = length - used
            take = n - start if n - start <= room else room - room % STEP
            if not take:
                sequence, used = sequence + 1, 0
                continue
            end = start + take
            after = crcs[-1] if end == n else crcs[end // STEP]
            yield (doc_id, start, take, crc_between(crcs[start // STEP], after, 4 * take), n, sequence, used)
            start, used = end, used + take
            if used == length:
                sequence, used = sequence + 1, 0


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [field.split()[0] for field in PIECE.split(", ")]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs_of(batches, ["part"]):
        base = group.column("part")[0].as_py() << 32
        rows = zip(*(group.column(c).to_pylist() for c in ("doc_id", "n", "marks")), strict=True)
        pieces = list(cut(rows))
        columns = [pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)]
        columns[5] = pa.array(np.array([p[5] for p in pieces], dtype=np.int64) + base)
        yield pa.RecordBatch.from_arrays(columns, _NAMES)


def queue_places(docs: DataFrame, rows: int) -> DataFrame:
    """``docs`` with ``before``: the tokens ahead of each in its source's queue, and ``total``.

    A queue is in hashed order. It is counted in buckets of about QUEUE_ROWS
    documents, then over the buckets' sums, so that no source is one task.
    """
    key = F.xxhash64("doc_id", "n", "marks")
    placed = docs.withColumn("key", key).withColumn(
        "bucket", F.pmod("key", F.lit(parts_for(rows, QUEUE_ROWS))))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n").alias("tokens"))
    queue = W.partitionBy("source")
    sums = sums.select(
        "source", "bucket", F.sum("tokens").over(queue).alias("total"),
        F.coalesce(F.sum("tokens").over(queue.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("ahead"))
    near = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "n", "marks")
    inside = F.sum("n").over(near.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return placed.withColumn("inside", inside).join(sums, ["source", "bucket"]).withColumn(
        "before", F.col("ahead") + F.col("inside"))


def pack(docs: DataFrame, tokenizer: str, weights: dict[str, float] | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of documents in sequences of LENGTH tokens: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    A document is the ids of its text and then id 1; null text counts as empty
    and leaves that one id. Every id lies in one piece; repeated rows are packed
    as often as they occur; a null id or source is a value like any other (null
    sources share a queue). No rows give no pieces. Other columns are ignored.

    Deficit round robin: in each turn (TURN sequences) every source's queue
    earns its share of the tokens, and sends documents while it has credit;
    what a document exceeds the credit by is carried as a deficit into the
    following turns, across windows and tasks. With f(d) tokens ahead of document d in
    its queue and a quantum q, d leaves in turn floor((f(d) + phase) / q), so
    every document's turn is known without running the turns one by one. A
    source's quantum is its part of all tokens, unless ``weights`` give it
    another; the phase is a hashed part of the document, so that the sources
    with few documents spread over the turns. Consecutive turns make a part that
    one task packs, with one partly filled sequence at its end.
    """
    spark = prepared(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"),
                       F.col(text_col).alias("text"))
    tokens = stage(docs.mapInArrow(
        _tokenised(tokenizer), "doc_id long, source string, n long, marks binary"), "tokens")
    rows, total = tokens.agg(F.count("*"), F.sum("n")).first()
    placed = queue_places(tokens, rows)
    turns = max(1.0, (total or 0) / (LENGTH * TURN))
    share = F.col("total") / F.lit(float(total or 1))
    if weights:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("=" + k, float(v))])
        share = F.coalesce(F.element_at(given, F.col("source")), share)
    phase = F.pmod(F.xxhash64("source"), F.lit(1000)) / 1000
    quantum = F.greatest(share * (LENGTH * TURN), F.lit(1e-9))
    turn = F.floor((F.col("before") + phase * F.col("n")) / quantum).cast("long")
    dealt = placed.select("doc_id", "n", "marks", turn.alias("turn"), "source", "before")
    dealt = dealt.withColumn("part", F.floor(F.col("turn") / TURNS).cast("long"))
    order = ["part", "turn", F.xxhash64("source", "turn"), "source", "before", "doc_id"]
    return dealt.repartition("part").sortWithinPartitions(*order).mapInArrow(_packed, PIECE)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
