"""Near duplicates by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import groups_of, prepared, stage, table
from tidemill.llm.components import components
from tidemill.llm.words import mix, mix1, shingle_hashes, word_hashes

#: Sketch coordinates: BANDS bands of ROWS coordinates each. At a similarity of
#: 0.8 a link shares no band with a probability of 8e-7, at 0.85 of 6e-10.
BANDS, ROWS = 28, 4
#: Members of a bucket, and shingles of theirs, that one task compares with each
#: other or with as many others; a larger bucket is dealt out by pairs of blocks.
BLOCK, BLOCK_SHINGLES = 768, 500_000
#: Links a task hands on at once.
LINKS = 5000
#: Shingles compared at once in a block.
COLUMNS = 4096


def sketches(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of each set: ``size`` coordinates, all filled.

    In round i < size every element falls in a hashed bin with the value i plus a
    hashed fraction; in round size + i it falls in bin i. A bin holds its least
    value, so later rounds only fill what is empty and a set leaves as soon as
    all its bins are full: O(size log size + elements) in all.
    """
    sets = len(first) - 1
    empty = np.uint64(2**64 - 1)
    out = np.full((sets, size), empty, dtype=np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(sets), np.diff(first))
    values = hashes
    for turn in range(2 * size):
        if not len(values):
            break
        h = mix(values ^ np.uint64(mix1(turn + 1)))
        bins = ((h >> np.uint64(40)) % np.uint64(size)).astype(np.int64) if turn < size else turn - size
        low = (np.uint64(turn) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
        np.minimum.at(flat, owner * size + bins, low)
        if turn >= size - 1 or turn < 4 or turn % 4 == 0:
            open_sets = (out == empty).any(axis=1)
            keep = open_sets[owner]
            owner, values = owner[keep], values[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, of the band's number and its coordinates."""
    keys = np.zeros((len(sketch), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(sketch), mix1(band + 1), dtype=np.uint64)
        for row in range(rows):
            key = mix(key * np.uint64(0xA0761D6478BD642F) + sketch[:, band * rows + row])
        keys[:, band] = key
    return keys


def text_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of every text, and where each text's begin."""
    words, first = word_hashes(texts)
    hashes, at = shingle_hashes(words, first, shingle)
    sets = [np.unique(hashes[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
    lengths = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    return (np.concatenate(sets) if sets else hashes), np.concatenate([[0], np.cumsum(lengths)])


def set_names(hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """16 bytes that name a set, the same for equal sets; None for an empty one."""
    if not len(hashes):
        return [None] * (len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    at = first[:-1][full]
    names = np.stack([np.add.reduceat(hashes, at), np.add.reduceat(mix(hashes + np.uint64(11)), at)], axis=1)
    out: list[bytes | None] = [None] * (len(first) - 1)
    for i, name in zip(full, mix(names), strict=True):
        out[i] = name.tobytes()
    return out


def _sketched(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = text_sets(batch.column("text"), shingle)
            keys = band_keys(sketches(hashes, first, bands * rows), bands, rows).view(np.int64)
            names = set_names(hashes, first)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(names) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(first)),
                 pa.array(names, pa.binary()), lists], ["doc_id", "text_hash", "n", "name", "bands"])
    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = text_sets(batch.column("text"), shingle)
            sets = [hashes[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_names(hashes, first), pa.binary()), pa.array(sets, pa.binary())],
                ["name", "members"])
    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share, by matrix products over blocks of elements."""
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(everything, return_inverse=True, return_counts=True)
    common = times > 1
    number = np.cumsum(common) - 1
    keep = common[place]
    owner, place = owner[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for begin in range(0, int(common.sum()), COLUMNS):
        i, j = np.searchsorted(place, [begin, begin + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[owner[i:j], place[i:j] - begin] = 1
        total += part @ part.T
    return total.astype(np.int64)


def forest_of(linked: np.ndarray, confirm: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric boolean matrix, of those that ``confirm`` accepts."""
    todo = np.ones(len(linked), dtype=bool)
    out = []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            near = np.flatnonzero(linked[at] & todo)
            if confirm:
                near = np.array([x for x in near if confirm(at, int(x))], dtype=np.int64)
            todo[near] = False
            out += [(at, int(x)) for x in near]
            stack += near.tolist()
    return out


def _verified(num: int, den: int):
    """Links within each block of a bucket, confirmed on the full sets; a spanning forest of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[bytes, bytes]] = []
        for names, members in groups_of(batches, ["bucket", "low", "high"], ["name", "members"]):
            if len(names) < 2:
                continue
            sets = [np.frombuffer(m, dtype=np.uint64) for m in members]
            sizes = np.array([len(s) for s in sets])
            if len(sets) == 2:  # most buckets
                both = np.concatenate(sets)
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                links = [(0, 1)] if den * shared >= num * (len(both) - shared) else []
            else:
                shared = shared_counts(sets)
                union = sizes[:, None] + sizes[None, :] - shared
                links = forest_of(den * shared >= num * union)
            found += [(names[i], names[j]) for i, j in links]
            if len(found) >= LINKS:
                yield link_batch(found)
                found = []
        yield link_batch(found)
    return run


def link_batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100,
                    bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept.

    Words are the runs outside ASCII white space after lower-casing A-Z; a set
    holds the distinct runs of ``shingle`` words, the whole sequence if there are
    fewer, nothing without words. Sets link at den * intersection >= num * union.
    ``component_id`` is the smallest id reachable over links, own id included;
    ``kept`` marks the documents that carry it. An empty set links with nothing,
    its document stays. A null id is kept only where no id is reachable. Rows
    that repeat id and text count as one document. Other columns are ignored.

    Equal sets fold into one node first, so copies never meet. Nodes that share a
    band meet in a bucket; buckets with the same members count once. A bucket is
    compared as a whole with matrix products on its sets; one larger than a block
    is dealt out by pairs of blocks. Tasks hand on a spanning forest of the
    confirmed links, never the pairs.
    """
    spark = prepared(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    marked = docs.withColumn("text_hash", text_hash(F.col("text")))
    sketched = stage(marked.mapInArrow(
        _sketched(shingle, bands, rows),
        "doc_id long, text_hash long, n long, name binary, bands array<long>"), "sketches")
    nodes = (sketched.filter("name is not null").groupBy("name")
             .agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"),
                  F.max("n").alias("n")))
    placed = stage(nodes.select("name", "n", F.explode("bands").alias("bucket"))
                   .withColumn("mark", F.xxhash64("name")), "bands")
    buckets = (placed.groupBy("bucket").agg(
        F.count("*").alias("m"), F.sum("n").alias("n"), F.sum(F.col("mark").cast("decimal(38,0)")).alias("who"))
        .filter("m > 1").groupBy("m", "n", "who").agg(F.min("bucket").alias("bucket"))
        .select("bucket", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("n") / BLOCK_SHINGLES))
                .cast("int").alias("blocks")))
    members = stage(placed.join(buckets, "bucket").select(
        "bucket", "name", "blocks", F.pmod("mark", F.col("blocks")).cast("int").alias("block")),
        "members")
    wanted = members.select("name").distinct()
    ids = (sketched.select("name", "doc_id").join(wanted, "name", "left_semi")
           .groupBy("name").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    sets = (docs.join(ids, docs.doc_id.eqNullSafe(ids.doc_id), "left_semi")
            .select("text").mapInArrow(_sets(shingle), "name binary, members binary")
            .groupBy("name").agg(F.any_value("members").alias("members")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (members.select("bucket", "name", "block", other.alias("other"))
             .select("bucket", F.least("block", "other").alias("low"),
                     F.greatest("block", "other").alias("high"), "name")
             .join(sets, "name"))
    links = (dealt.select("bucket", "low", "high", "name", "members")
             .repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
             .mapInArrow(_verified(num, den), "a binary, b binary"))
    reached = components(links)
    named = nodes.select("name", "doc_id").join(
        reached, F.col("name") == F.col("node"), "left").select(
        "name", "doc_id", F.coalesce("component", "name").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = named.join(smallest, "component").select("name", "component_id")
    out = sketched.join(found, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                      component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, without those whose group holds a smaller id."""
    kept = near_duplicates(docs, **options).filter("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["__id"]) & (text_hash(docs["text"]) == kept["__hash"])
    return docs.join(kept, same, "left_semi")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85).drop("text_hash")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3
    THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])
    END) AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
"""
