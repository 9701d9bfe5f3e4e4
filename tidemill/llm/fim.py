"""Fill-in-middle documents, cut through a learned index of word boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import prepared, table
from tidemill.llm.words import raw_bytes, word_bounds

# What stands before a prefix, a suffix and a middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: By how much a segment's prediction may differ from a boundary; residuals fit one signed byte.
ERROR = 127
#: Of 100 documents so many are rearranged, and of 100 of those so many with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42


@dataclass(frozen=True)
class RankIndex:
    """From (text, rank) to the offset behind that many units, for all texts of a batch.

    Offsets of a text, from 0 on, are covered by segments of a line each, that
    miss no boundary by more than ERROR. A rank is looked up by predicting on its
    segment's line and adding the stored residual, which is exact.
    """

    first: np.ndarray  # where each text's ranks begin among all of the batch
    begin: np.ndarray  # of each segment: its first rank among all,
    offset: np.ndarray  # the offset there,
    rise: np.ndarray  # and by how much offsets rise
    run: np.ndarray  # over so many ranks
    residual: np.ndarray

    @staticmethod
    def fit(offsets: np.ndarray, first: np.ndarray) -> RankIndex:
        """Halve segments, beginning with a text each, until none errs by more than ERROR."""
        residual = np.zeros(len(offsets), dtype=np.int8)
        begin, end = first, np.append(first[1:], len(offsets))
        done = []
        while len(begin):
            run = np.maximum(end - begin - 1, 1)
            low = offsets[begin]
            rise = offsets[end - 1] - low
            sizes = end - begin
            edges = np.cumsum(sizes) - sizes
            along = np.arange(int(sizes.sum())) - np.repeat(edges, sizes)
            at = np.repeat(begin, sizes) + along
            missed = offsets[at] - (np.repeat(low, sizes) + np.repeat(rise, sizes) * along // np.repeat(run, sizes))
            good = np.maximum.reduceat(np.abs(missed), edges) <= ERROR
            near = np.repeat(good, sizes)
            residual[at[near]] = missed[near]
            done.append(np.stack([begin[good], low[good], rise[good], run[good]]))
            begin, end = begin[~good], end[~good]
            middle = (begin + end) // 2
            begin, end = np.concatenate([begin, middle]), np.concatenate([middle, end])
        parts = np.concatenate(done, axis=1) if done else np.zeros((4, 0), np.int64)
        return RankIndex(first, *parts[:, np.argsort(parts[0])], residual)

    def cut(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The offsets behind the first ``ranks`` units of the texts."""
        at = self.first[texts] + ranks
        segment = np.searchsorted(self.begin, at, side="right") - 1
        along = at - self.begin[segment]
        return self.offset[segment] + self.rise[segment] * along // self.run[segment] + self.residual[at]


def boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, in characters, of 0 and the end of every unit of every text; where each text's begin.

    A unit is a word with the white space ahead of it; white space at a text's end is one more.
    """
    raw, edges = raw_bytes(texts)
    _, ends = word_bounds(raw, edges)
    owner = np.searchsorted(edges, ends, side="left") - 1
    sizes = np.diff(edges)
    words = np.bincount(owner, minlength=len(sizes))
    last = np.zeros(len(sizes), dtype=np.int64)  # the end of each text's last word
    last[owner] = ends  # ends ascend: the last one of a text stays
    blank_end = (sizes > 0) & ((words == 0) | (last < edges[1:]))
    counts = 1 + words + blank_end
    first = np.cumsum(counts) - counts
    at = np.zeros(int(counts.sum()), dtype=np.int64)
    at[first] = edges[:-1]
    place = np.arange(len(ends)) - np.repeat(np.cumsum(words) - words, words)
    at[first[owner] + 1 + place] = ends
    at[(first + counts - 1)[blank_end]] = edges[1:][blank_end]
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return characters[at] - np.repeat(characters[edges[:-1]], counts), first


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the id alone; a null id counts as the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def _rearranged(seed: int, rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column("text").to_pylist()]
            offsets, first = boundaries(batch.column("text"))
            index = RankIndex.fit(offsets, first)
            units = np.diff(np.append(first, len(offsets))) - 1
            numbers = np.array([draws(i, seed) for i in batch.column("doc_id").to_pylist()], dtype=np.int64)
            ranks = np.sort(numbers[:, :2] % (units[:, None] + 1), axis=1)
            every = np.arange(len(texts))
            cuts = np.stack([index.cut(every, ranks[:, 0]), index.cut(every, ranks[:, 1])], axis=1).tolist()
            forms, before, inside, outputs = [], [], [], []
            for text, (a, b), (_, _, h3, h4) in zip(texts, cuts, numbers.tolist(), strict=True):
                if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
                    forms.append("plain")
                    before.append(None)
                    inside.append(None)
                    outputs.append(text)
                    continue
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                before.append(a)
                inside.append(b - a)
                if h4 % 100 < suffix_first:
                    forms.append("spm")
                    outputs.append("".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
                else:
                    forms.append("psm")
                    outputs.append("".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(units, pa.int64()), pa.array(forms), pa.array(before, pa.int64()),
                 pa.array(inside, pa.int64()), pa.array(outputs, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document.

    ``n`` counts the units of the whole text; two ranks drawn from the id and ``seed`` cut it, and
    the parts are put in the order prefix, suffix, middle (``psm``) or suffix, prefix, middle
    (``spm``). Texts that are empty or hold one of the three marks, and those not
    drawn, stay as they are (``plain``, the two numbers null). Null text counts as empty;
    a null id draws like the empty string; repeated rows come out alike; a text of one unit may have
    empty parts; other columns are ignored. No rows give no rows. A document's result
    depends on nothing but its own id and text.
    """
    prepared(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(
        _rearranged(seed, rate, suffix_first),
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of. Marks can't arise across parts, as none begins inside another."""
    parts = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
e AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM e),
g AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""
