"""Text quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import prepared, table
from tidemill.llm.words import LOWER, hash_spans, mix, raw_bytes, word_bounds

#: Labelled rows a model is fitted on, at most: the first in hashed order of their ids.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE = 80, 4, 48, 0.15
THRESHOLD = 0.7

FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_words", "upper", "digits", "marks", "symbols",
    "blanks", "lines_per_word", "other_bytes", "symbol_words", "symbol_ends", "upper_words",
    "repeats", "distinct", "top_word", "repeated_pairs", "repeated_lines", "one_letter",
)

_UPPER, _DIGIT, _MARK, _SYMBOL, _BLANK, _LINE, _HIGH = (np.zeros(256, dtype=bool) for _ in range(7))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b".,;:'\"()-?")] = True
_SYMBOL[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = True
_BLANK[list(b" \t\r\x0b\x0c")] = True
_LINE[10] = True
_HIGH[128:] = True


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return top / np.maximum(bottom, 1)


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many different hashes it has, and how often its most frequent one occurs."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    keys = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, counts = np.unique(keys, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, owner[at], counts)
    return np.bincount(owner[at], minlength=n).astype(float), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for every text; null and empty texts have zeros."""
    raw, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends = word_bounds(raw, offsets)
    first = np.searchsorted(starts, offsets)
    words = np.diff(first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    lengths = ends - starts

    def of_bytes(kind):
        total = np.concatenate([[0], np.cumsum(kind[raw])])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def of_words(mask):
        return np.bincount(owner, weights=mask, minlength=n)

    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    hashes = hash_spans(LOWER[raw], starts, ends)
    after = np.zeros(len(hashes), dtype=bool)
    pairs, pair_owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) > 1:
        same_text = owner[1:] == owner[:-1]
        after[1:] = (hashes[1:] == hashes[:-1]) & same_text
        pairs = mix(hashes[1:] + hashes[:-1] * np.uint64(3))[same_text]
        pair_owner = owner[1:][same_text]
    distinct, top = _distinct(hashes, owner, n)
    distinct_pairs, _ = _distinct(pairs, pair_owner, n)
    breaks = np.unique(np.concatenate([offsets, np.flatnonzero(_LINE[raw]) + 1])) if len(raw) else offsets[:1]
    line_starts, line_ends = breaks[:-1], breaks[1:]
    line_owner = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(float) if len(line_starts) else np.zeros(n)
    distinct_lines, _ = _distinct(hash_spans(raw, line_starts, line_ends), line_owner, n)
    pair_count = np.maximum(words - 1, 0)
    out = np.stack([
        np.log1p(size), np.log1p(words), _ratio(of_words(lengths), words), _ratio(of_words(lengths > 15), words),
        _ratio(of_bytes(_UPPER), size), _ratio(of_bytes(_DIGIT), size), _ratio(of_bytes(_MARK), size),
        _ratio(of_bytes(_SYMBOL), size), _ratio(of_bytes(_BLANK), size), _ratio(of_bytes(_LINE), words),
        _ratio(of_bytes(_HIGH), size),
        _ratio(of_words((lengths == 1) & _SYMBOL[raw[starts]]), words) if len(starts) else np.zeros(n),
        _ratio(of_words(_SYMBOL[raw[ends - 1]]), words) if len(starts) else np.zeros(n),
        _ratio(of_words((upper[ends] - upper[starts]) * 2 > lengths), words) if len(starts) else np.zeros(n),
        _ratio(of_words(after), words), _ratio(distinct, words), _ratio(top, words),
        _ratio(pair_count - distinct_pairs, pair_count), _ratio(lines - distinct_lines, lines),
        _ratio(of_words(lengths == 1), words),
    ], axis=1)
    return out.astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Complete trees, each flattened into arrays in heap order."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    above: np.ndarray  # go right where the statistic is above this
    leaf: np.ndarray  # (trees, 2**depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 for every row; all rows walk a tree at once."""
        total = np.full(len(rows), self.base)
        inner = self.feature.shape[1] if len(self.feature) else 0
        everyone = np.arange(len(rows))
        for feature, above, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (rows[everyone, feature[at]] > above[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
        rate: float = RATE, smooth: float = 1.0, least: float = 5.0, weights: np.ndarray | None = None) -> Trees:
    """Boosted trees for the logistic loss, split on histograms of binned statistics.

    Rows count by their weights. Without rows, or with one label only, the score is that label's smoothed share.
    """
    weights = np.ones(len(labels)) if weights is None else weights
    share = ((labels * weights).sum() + 1) / (weights.sum() + 2)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    flat: tuple[list, list, list] = ([], [], [])
    if len(rows) and 0 < labels.sum() < len(labels):
        count = rows.shape[1]
        edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
                 for f in range(count)]
        binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(count)], axis=1)
        margin = np.full(len(rows), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            slope, curve = weights * (labels - p), weights * p * (1 - p)
            feature, above = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
            at = np.zeros(len(rows), dtype=np.int64)
            for level in range(depth):
                base_node, nodes = 2**level - 1, 2**level
                local = at - base_node
                best = np.zeros(nodes)
                pick = np.full(nodes, -1)
                cut = np.zeros(nodes, np.int64)
                for f in range(count):
                    if not len(edges[f]):
                        continue
                    width = len(edges[f]) + 1
                    cell = local * width + binned[:, f]
                    g = np.bincount(cell, slope, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    h = np.bincount(cell, curve, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    g_all, h_all = g[:, -1:], h[:, -1:]
                    gain = (g**2 / (h + smooth) + (g_all - g)**2 / (h_all - h + smooth)
                            - g_all**2 / (h_all + smooth))[:, :-1]
                    rows_left = np.bincount(cell, weights, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    low, high = rows_left[:, :-1], rows_left[:, -1:] - rows_left[:, :-1]
                    gain[(low < least) | (high < least)] = 0
                    where = gain.argmax(axis=1)
                    value = gain[np.arange(nodes), where]
                    better = value > best + 1e-9
                    best[better], pick[better], cut[better] = value[better], f, where[better]
                for node in np.flatnonzero(pick >= 0):
                    feature[base_node + node] = pick[node]
                    above[base_node + node] = edges[pick[node]][cut[node]]
                at = 2 * at + 1 + (rows[np.arange(len(rows)), feature[at]] > above[at])
            leaf_at = at - inner
            g = np.bincount(leaf_at, slope, inner + 1)
            h = np.bincount(leaf_at, curve, inner + 1)
            leaf = rate * g / (h + smooth)
            margin += leaf[leaf_at]
            for store, values in zip(flat, (feature, above, leaf), strict=True):
                store.append(values)
    shape = (len(flat[0]), inner)
    return Trees(base, np.array(flat[0], np.int64).reshape(shape), np.array(flat[1], np.float32).reshape(shape),
                 np.array(flat[2]).reshape(shape[0], inner + 1))


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = statistics(batch.column("text"))
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), lists], ["doc_id", "quality", "statistics"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """A model from at most ``sample`` labelled documents that are not held out.

    Which ones follows from their ids alone: the first in hashed order. Only
    their statistics (20 numbers a row) reach the driver. Null labels and ids are
    passed over; the label is the only thing taken from ``labels``, the lower one where an id has both. An id counts
    once however often its rows are repeated; of different texts under one id the first by hash counts.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .filter(~held_out()).filter("doc_id is not null and quality in (0, 1)")
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = (texts.join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
            .mapInArrow(_labelled, "doc_id long, quality int, statistics array<float>")
            .orderBy("doc_id").toArrow())
    matrix = rows.column("statistics").combine_chunks()
    values = matrix.flatten().to_numpy() if len(rows) else np.zeros(0, np.float32)
    return fit(values.reshape(-1, len(FEATURES)), rows.column("quality").to_numpy().astype(float))


def _scored(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])
    return run


def quality_scores(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of every document: the probability that it is worth keeping.

    The text alone decides; null counts as empty, which has a score too. Repeated
    rows are scored each. Other columns are ignored; no rows give no rows.
    """
    prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scored(model), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, all their columns as they were."""
    prepared(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(statistics(batch.column("text"))) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = quality_scores(docs, train(docs, labels))
    return scores.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
