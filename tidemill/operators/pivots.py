"""Exact top-k vectors without scoring all pairs: rows in cells around pivots, visited by their bound.

On the unit sphere angles are distances. A row at angle t from its cell's pivot
is at least |f - t| away from a query at angle f from that pivot, so a part of
the cell whose rows lie between angles a and b holds nothing nearer than the cosine of the least such
difference. A first round scores, for every query, the parts of best bound that hold k
rows; their k-th score is a floor. A second round scores the
parts whose bound reaches the floor. What neither visits is proven to be no better, so the result is
that of comparing all pairs. How much is left out depends on how the vectors cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import nearest as flat
from tidemill.session import stage

PIVOTS = 128          # cells, at most
SAMPLE = 2048         # rows the pivots are chosen from
PART_ROWS = 50_000    # rows of a cell's part scored at once
QUERY_ROWS = 8192     # queries that meet a part at once
SLACK = 1e-6          # far more than angles and products differ by rounding
ZEROS = -1            # the cell of vectors without a direction


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows at length 1, and which of them have a direction."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norms > 0, norms, 1)[:, None], norms > 0


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def far_apart(rows: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the unit rows, each the farthest from those before; fewer where no others are left."""
    chosen, gap = [], np.full(len(rows), np.inf)
    at = 0
    while len(chosen) < count and len(rows) and gap[at] > SLACK:
        chosen.append(rows[at])
        gap = np.minimum(gap, _angles(rows, rows[at:at + 1])[:, 0])
        at = int(gap.argmax())
    return np.array(chosen).reshape(len(chosen), rows.shape[1] if rows.ndim == 2 else 0)


@dataclass(frozen=True)
class PivotIndex:
    """A store's rows (id, embedding, cell, ring, part), written and read back, and what its parts span.

    A cell is cut into rings by angle, a ring into parts by hash of the id where
    equal vectors fill it. The driver and every query task hold the pivots and five numbers for each ring: there are
    at most PIVOTS rings more than the store has times PART_ROWS rows.
    """

    rows: DataFrame
    pivots: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The best cosine any row of each ring can have, for unit queries."""
        at = _angles(queries, self.pivots)[:, self.cell]
        return np.cos(np.maximum(np.maximum(at - self.high, self.low - at), 0))

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Which rings the first round visits: those of best bound that hold k rows together."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(out, order, held < k, axis=1)
        return out


def build(store: DataFrame, pivots: int = PIVOTS, part_rows: int = PART_ROWS) -> PivotIndex:
    """Index all rows of ``store`` (id, embedding); the pivots are chosen from SAMPLE rows in hashed order."""
    store = store.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    directed = F.exists("embedding", lambda value: value != 0)
    sample = store.filter(directed).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    centers = far_apart(_unit(flat._matrix(sample.column("embedding")))[0], pivots)
    schema = T.StructType([*store.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("angle", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, has = _unit(flat._matrix(batch.column("embedding")))
            if len(centers):
                angles = _angles(rows, centers)
                cell = np.where(has, angles.argmin(axis=1), ZEROS)
                angle = np.where(has, angles.min(axis=1), 0.0)
            else:
                cell, angle = np.full(len(rows), ZEROS), np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], ["id", "embedding", "cell", "angle"])

    placed = stage(store.mapInArrow(assign, schema), "cells")
    cells = placed.groupBy("cell").agg(F.min("angle").alias("least"), F.max("angle").alias("most"),
                                       F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("rings"))
    width = (F.col("most") - F.col("least")) / F.col("rings")
    ring = F.least(F.col("rings") - 1, F.floor((F.col("angle") - F.col("least")) / F.nullif(width, F.lit(0.0))).cast("int"))
    ringed = placed.join(F.broadcast(cells), "cell").withColumn("ring", F.coalesce(ring, F.lit(0)))  # a row a cell
    spans = stage(ringed.groupBy("cell", "ring").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("count")), "rings")
    parts = F.ceil(F.col("count") / part_rows).cast("int")
    rows = stage(ringed.join(spans.select("cell", "ring", parts.alias("parts")), ["cell", "ring"]).select(
        "id", "embedding", "cell", "ring", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts"),
        "parts")
    found = spans.filter(F.col("cell") != ZEROS).orderBy("cell", "ring").toArrow()
    values = {name: found.column(name).to_numpy() for name in ("cell", "ring", "low", "high", "count")}
    return PivotIndex(rows, centers, **values)


def visits(index: PivotIndex, queries: DataFrame, k: int, floors: bool = False) -> DataFrame:
    """(qid, embedding, cell, ring) a round visits, of ``queries`` (qid, embedding and, in the second round, floor)."""
    schema = T.StructType([*[queries.schema[name] for name in ("qid", "embedding")],
                           T.StructField("cell", T.IntegerType()), T.StructField("ring", T.IntegerType())])
    spans = PivotIndex(None, index.pivots, index.cell, index.ring, index.low, index.high, index.count)
    step = max(1, 4_000_000 // max(1, len(index.cell)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                rows, has = _unit(flat._matrix(batch.column("embedding")))
                bounds = spans.bounds(rows)
                wanted = spans.first(bounds, k)
                if floors:
                    floor = batch.column("floor").to_numpy(zero_copy_only=False)
                    wanted = ~wanted & (bounds >= floor[:, None] - SLACK)
                query, ring = np.nonzero(wanted & has[:, None])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("qid").take(pa.array(query)), batch.column("embedding").take(pa.array(query)),
                     pa.array(spans.cell[ring].astype(np.int32)), pa.array(spans.ring[ring].astype(np.int32))],
                    ["qid", "embedding", "cell", "ring"])

    return queries.mapInArrow(choose, schema)


def _score(index: PivotIndex, wanted: DataFrame, k: int, slices: int, schema: T.StructType) -> DataFrame:
    """The k best rows for each query and part visited; parts meet their queries by slices of bounded size."""
    arrow = flat._arrow_schema(schema)
    keys = ["cell", "ring", "part", "slice"]

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        best = flat._Best(flat._matrix(queries.column("embedding")), k, arrow.field("id").type)
        if queries.num_rows and rows.num_rows:
            best.add(rows.column("id"), flat._matrix(rows.column("embedding")))
        return best.table(queries.column("qid"), arrow)

    parts = index.rows.groupBy("cell", "ring").agg(F.first("parts").alias("parts"))
    left = (wanted.join(parts, ["cell", "ring"])
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            .withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)).cast("int")))
    right = (index.rows.join(wanted.select("cell", "ring").distinct(), ["cell", "ring"], "left_semi").drop("parts")
             .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))
    left, right = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: PivotIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """(qid, rank, id, score): for every query (qid, embedding) its k nearest rows, as ``nearest`` gives them.

    Ties go to the lower id. Rows without a direction score null and come last, by id; a query without
    one finds the k lowest ids. Repeated query ids must hold the same vector.
    """
    queries = stage(queries.select("qid", F.col("embedding").cast("array<float>").alias("embedding")), "queries")
    store = index.rows.select("id", "cell")
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType),
                           T.StructField("id", store.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    slices = max(1, math.ceil(queries.count() / QUERY_ROWS))
    hits = queries.sparkSession.createDataFrame([], schema)
    if len(index.cell):
        directed = queries.filter(F.exists("embedding", lambda value: value != 0))
        near = stage(_score(index, stage(visits(index, directed, k), "visits"), k, slices, schema), "near")
        floor = _top(near, k).groupBy("qid").agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("floor"))
        floored = directed.join(floor, "qid")
        far = _score(index, stage(visits(index, floored, k, floors=True), "visits"), k, slices, schema)
        hits = near.unionByName(far)
    # k ids each: what queries without a direction find, and what is left where few rows have one.
    lowest = [row[0] for row in store.select("id").orderBy("id").limit(k).collect()]
    blank = [row[0] for row in store.filter(F.col("cell") == ZEROS).select("id").orderBy("id").limit(k).collect()]

    def given(asked: DataFrame, ids: list) -> DataFrame:
        literal = F.array(*[F.lit(i) for i in ids]).cast(T.ArrayType(schema["id"].dataType))
        return asked.select("qid", F.explode(literal).alias("id"), F.lit(None).cast("double").alias("score"))

    directed = F.exists("embedding", lambda value: value != 0)
    if lowest:
        hits = hits.unionByName(given(queries.filter(~directed), lowest))
    if blank and index.count.sum() < k:
        hits = hits.unionByName(given(queries.filter(directed), blank))
    return _top(hits, k).select("qid", "rank", "id", "score")
