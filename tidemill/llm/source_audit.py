"""How the words of a language's sources diverge, from exact sparse document vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.llm.common import parts_for, prepared, stage, table
from tidemill.llm.words import LOWER, hash_spans, raw_bytes

#: Documents of its language a term must occur in.
MIN_DOCS = 30
#: Added to every count, and what a share of 1 is counted as.
SMOOTH, SCALE = 5, 1_000_000_000
#: Terms reported of a group.
TOP = 50
#: Terms of one vocabulary, about: what a fit brings to the driver and a task holds.
SLICE_TERMS = 1_000_000
#: One term in so many is counted ahead to learn how many vocabularies it takes.
SAMPLED = 64
#: Cells of one task's block of a pair's sums, and rows of sources it holds at once.
BLOCK_CELLS, BLOCK_SOURCES = 100_000, 512
#: No term can hold it: stands between a language and its term, and alone for "any document".
MARK = "\x00"

#: Entries a task sums before it hands them on, and neighbouring entries of a vector that travel together.
HELD, BLOCK = 4_000_000, 4096

_INSIDE = np.zeros(256, dtype=bool)  # bytes of terms: ASCII letters, and all of any other character
_INSIDE[97:123] = True
_INSIDE[128:] = True


def _spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every term, and its text."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = _INSIDE[raw]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _lists(flat: pa.Array, owner: np.ndarray, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]), pa.int32()), flat)


def _marked(sampled: int):
    """A row of each text's terms, once each and led by its language and MARK, and by MARK alone; then for each
    bit of how often terms occur besides, a row of those that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            raw, offsets = raw_bytes(batch.column("text"))
            raw = LOWER[raw]
            starts, ends, owner = _spans(raw, offsets)
            edges = np.concatenate([[0], np.cumsum(ends - starts)])
            coded = pa.Array.from_buffers(pa.string(), len(starts), [
                None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(raw[_INSIDE[raw]].tobytes())]).dictionary_encode()
            codes, size = coded.indices.to_numpy(), max(1, len(coded.dictionary))
            key, times = np.unique(owner * size + codes, return_counts=True)
            owner, code, times = key // size, key % size, times - 1
            lang = batch.column("lang").dictionary_encode()
            led, which = np.unique(lang.indices.to_numpy()[owner] * size + code, return_inverse=True)
            terms = pc.binary_join_element_wise(
                lang.dictionary.take(pa.array(led // size)), coded.dictionary.take(pa.array(led % size)), MARK)
            terms = pa.concat_arrays([terms, pa.array([MARK])])
            known, ends = raw_bytes(coded.dictionary)
            some = np.flatnonzero((hash_spans(known, ends[:-1], ends[1:]) % np.uint64(sampled) == 0)[code])

            def rows(part: int, flat: np.ndarray, owners: np.ndarray, picked: np.ndarray) -> pa.RecordBatch:
                own = np.unique(owners)
                place = np.searchsorted(own, owners)
                return pa.RecordBatch.from_arrays(
                    [batch.column("lang").take(pa.array(own)), batch.column("source").take(pa.array(own)),  # noqa: B023
                     pa.array(np.full(len(own), part), pa.int32()), _lists(terms.take(pa.array(flat)), place, len(own)),  # noqa: B023
                     _lists(terms.take(pa.array(which[picked])), owner[picked], len(own))],  # noqa: B023
                    ["lang", "source", "part", "terms", "some"])

            first = np.searchsorted(owner, np.arange(n))
            yield rows(0, np.insert(which, first, len(led)), np.insert(owner, first, np.arange(n)), some)
            for bit in range(int(times.max(initial=0)).bit_length()):
                has = np.flatnonzero(times >> bit & 1)
                yield rows(bit + 1, which[has], owner[has], some[:0])

    return run


def marked_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                 source_col: str = "source") -> DataFrame:
    """(lang, source, part, terms, some): every document's words, each led by its language; nulls count as empty.

    A document has a row with part 0 that holds each of its terms once, and MARK. What a term occurs
    besides is a sum of powers of two: the row with part p > 0 holds the terms that have 2 ** (p - 1) in it.
    So vectors need a term as often as its count has bits, not as often as it occurs.
    ``some`` has those of one term in SAMPLED, by hash, that the document holds, once each.
    """
    def known(name: str, alias: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)

    return docs.select(known(lang_col, "lang"), known(source_col, "source"), known(text_col, "text")).mapInArrow(
        _marked(SAMPLED), "lang string, source string, part int, terms array<string>, some array<string>")


def _of_slice(i: int, slices: int) -> Column:
    return F.filter("terms", lambda term: (F.pmod(F.xxhash64(term), F.lit(slices)) == i) | (term == MARK))


def vocabularies(documents: DataFrame, min_docs: int, slice_terms: int) -> int:
    """Into how many vocabularies the kept terms go: from an exact count of one term in SAMPLED."""
    kept = (documents.select(F.explode("some").alias("term"))
            .groupBy("term").count().filter(F.col("count") >= min_docs).count())
    return parts_for(kept * SAMPLED, slice_terms)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def _blocks(most: int, width: int):
    """The sum of a task's sparse vectors, times their weights, for every source, in blocks of neighbouring entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, counts, held = [], [], 0

        def sums() -> Iterator[pa.RecordBatch]:
            key, count = _summed(keys, counts)
            part = key // width
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            edges = pa.array(np.append(begin, len(key)), pa.int32())
            who, word = list(names), 1 << 32
            yield pa.RecordBatch.from_arrays(
                [pa.array([who[k // word] for k in key[begin].tolist()]), pa.array(key[begin] % word // width, pa.int32()),
                 pa.ListArray.from_arrays(edges, pa.array(key % width, pa.int32())),
                 pa.ListArray.from_arrays(edges, pa.array(count))], ["source", "block", "at", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.array([names.setdefault(name, len(names)) for name in batch.column("source").to_pylist()], dtype=np.int64)
            indices, values = batch.column("indices"), batch.column("values")
            sizes = np.diff(np.asarray(indices.offsets))
            keys.append(np.repeat(code << 32, sizes) + np.asarray(indices.flatten(), dtype=np.int64))
            weight = batch.column("weight").to_numpy()
            counts.append(np.asarray(values.flatten()).astype(np.int64) * np.repeat(weight, sizes))
            held += len(keys[-1])
            if held > most:
                key, count = _summed(keys, counts)
                keys, counts, held = [key], [count], len(key)
                if held > most // 2:  # as many that differ: they go on as they are
                    yield from sums()
                    keys, counts, held = [], [], 0
        if held:
            yield from sums()

    return run


def _entries(width: int):
    """The sums of blocks that stand side by side, an entry a row; holds one block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(width, dtype=np.int64)

        def rows() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]] * len(at), pa.string()), pa.array(at + last[1] * width, pa.int32()), pa.array(total[at])],
                ["source", "index", "n"])

        for batch in batches:
            at, n = batch.column("at"), batch.column("n")
            for i, key in enumerate(zip(batch.column("source").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                if key != last:
                    if last is not None:
                        yield rows()
                    last, total = key, np.zeros(width, dtype=np.int64)
                total[np.asarray(at[i].values)] += np.asarray(n[i].values)
        if last is not None:
            yield rows()

    return run


def term_sums(documents: DataFrame, min_docs: int = MIN_DOCS, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(lang, source, term, n): how often each source of a language has each kept term, where it has it.

    A term led by its language occurs in that language's documents alone, so one
    CountVectorizer with a minimum number of documents and no limit to its
    vocabulary does what one for each language would. Its vocabulary reaches
    the driver and every task, so terms are dealt by hash into vocabularies
    of bounded size; it is fitted on the documents' distinct terms. Documents become sparse vectors over
    each, the sum of their parts' vectors times weights. Tasks add up the vectors of every source and send
    the sums in blocks of entries.
    """
    spark = documents.sparkSession
    parts = []
    whole = documents.filter("part = 0")
    if whole.limit(min_docs).count() >= min_docs:  # with fewer documents no term is kept
        slices = vocabularies(whole, min_docs, slice_terms)
        for i in range(slices):
            # MARK is in every document, so that no vocabulary is empty.
            terms = (F.col("terms") if slices == 1 else _of_slice(i, slices)).alias("terms")
            model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs),
                                    vocabSize=2**31 - 1).fit(whole.select(terms))
            vector = F.unwrap_udt("vector")
            weight = F.pow(F.lit(2), F.greatest(F.col("part") - 1, F.lit(0))).cast("long").alias("weight")
            vectors = model.transform(documents.select("source", weight, terms)).select(
                "source", "weight", vector["indices"].alias("indices"), vector["values"].alias("values"))
            blocks = vectors.mapInArrow(_blocks(HELD, BLOCK), "source string, block int, at array<int>, n array<long>")
            sums = (blocks.repartition("source", "block").sortWithinPartitions("source", "block")
                    .mapInArrow(_entries(BLOCK), "source string, index int, n long"))
            words = [word.rpartition(MARK) for word in model.vocabulary]
            names = spark.createDataFrame(pa.table({
                "index": pa.array([j for j, word in enumerate(words) if word[2]], pa.int32()),
                "lang": pa.array([word[0] for word in words if word[2]], pa.string()),
                "term": pa.array([word[2] for word in words if word[2]], pa.string())}))
            parts.append(stage(sums.join(names, "index").select("lang", "source", "term", "n"), "term-sums"))
    if not parts:
        return spark.createDataFrame([], "lang string, source string, term string, n long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), without rounding on the way."""
    top = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + terms * SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", top, below) + 1


def _pair_sums(cells: pa.Table, bases: pa.Table) -> pa.Table:
    """Of each source of the block a row of its summed differences to all sources, over the cells' terms."""
    bases = bases.sort_by("no")
    lang, part = bases.column("lang")[0].as_py(), bases.column("part")[0].as_py()
    base = bases.column("base").to_numpy()
    mine = range(part * BLOCK_SOURCES, min(len(base), (part + 1) * BLOCK_SOURCES))
    sums = np.zeros((len(mine), len(base)), dtype=np.int64)
    if cells.num_rows:
        cells = cells.sort_by("term")
        _, term = np.unique(cells.column("term").to_numpy(zero_copy_only=False), return_inverse=True)
        no, p = cells.column("no").to_numpy(), cells.column("p").to_numpy()
        height = max(1, 2_000_000 // len(base))
        for low in range(0, int(term[-1]) + 1, height):
            begin, end = np.searchsorted(term, [low, low + height])
            rows = np.repeat(base[None, :], int(term[end - 1]) - low + 1, axis=0)
            rows[term[begin:end] - low, no[begin:end]] = p[begin:end]
            for i, own in enumerate(mine):
                sums[i] += np.abs(rows - rows[:, own:own + 1]).sum(axis=0)
    values = pa.ListArray.from_arrays(
        pa.array(np.arange(len(mine) + 1) * len(base), pa.int32()), pa.array(sums.reshape(-1)))
    return pa.table({"lang": pa.array([lang] * len(mine), pa.string()), "no": pa.array(list(mine), pa.int32()),
                     "sums": values})


def pair_divergence(cells: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language their summed difference.

    A term that a source lacks has that source's base share. Terms are dealt
    into blocks by hash; a block's cells meet the language's bases in one task, which
    returns sums only. A language with so many sources that their sums don't fit has them in parts.
    """
    buckets = parts_for(rows, BLOCK_CELLS)
    parts = F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / BLOCK_SOURCES).cast("int"))
    left = cells.select("lang", "no", "p", "term", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"),
                        F.explode(parts).alias("part"))
    bases = groups.select("lang", "no", "base", F.explode(parts).alias("part")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    keys = ["lang", "bucket", "part"]
    sums = left.groupBy(*keys).cogroup(bases.groupBy(*keys)).applyInArrow(
        _pair_sums, "lang string, no int, sums array<long>")
    pairs = (sums.select("lang", "no", F.posexplode("sums").alias("other", "value"))
             .groupBy("lang", "no", "other").agg(F.sum("value").alias("value")).filter("no <> other"))
    names = groups.select("lang", "no", "source")
    others = groups.select("lang", F.col("no").alias("other"), F.col("source").alias("item"))
    return pairs.join(names, ["lang", "no"]).join(others, ["lang", "other"]).select("lang", "source", "item", "value")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, slice_terms: int = SLICE_TERMS,
               text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from its language's others.

    Part ``pair`` has each other source of the language with the summed
    difference of smoothed shares over all kept terms; part ``term`` the ``top`` terms by which the source's
    share exceeds the language's. Nulls count as empty strings; ties are ranked by the item's bytes. Every
    (lang, source) that occurs has its pairs, also one without terms; where no term is kept they are 0. Repeated rows
    count as often as they occur; other columns are ignored, ids too. No rows give no rows. All
    counts cover all documents, and a source with a third of them is spread like the rest.
    """
    prepared(docs.sparkSession)
    documents = stage(marked_terms(docs, text_col, lang_col, source_col), "terms")
    cells = stage(term_sums(documents, min_docs, slice_terms), "cells")
    whole = cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = whole.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    found = documents.filter("part = 0").select("lang", "source").distinct()
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    in_lang = W.partitionBy("lang")  # one row for each source
    groups = stage(
        found.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("terms", none).alias("terms"),
                "lang_total", (F.row_number().over(in_lang.orderBy("source")) - 1).alias("no"),
                F.count("*").over(in_lang).alias("sources"))
        .withColumn("base", F.when(F.col("terms") > 0, share(none, F.col("total"), F.col("terms"))).otherwise(none)),
        "groups")
    shares = stage(cells.join(groups, ["lang", "source"]).withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("terms"))), "shares")
    pairs = pair_divergence(shares, groups, cells.count())
    over = (shares.join(whole, ["lang", "term"])
            .withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
            .filter("value > 0").select("lang", "source", F.col("term").alias("item"), "value"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def part(name: str, rows: DataFrame) -> DataFrame:
        return rows.select("lang", "source", F.lit(name).alias("part"), "item", "value",
                           F.row_number().over(ranked).alias("rank"))

    return part("pair", pairs).unionByName(part("term", over).filter(F.col("rank") <= top))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
cells AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (
  SELECT x.lang, x.source, coalesce(any_value(l.v), 0) AS v, any_value(l.total) AS lang_total, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l ON l.lang = x.lang
       LEFT JOIN cells c ON c.lang = x.lang AND c.source = x.source GROUP BY x.lang, x.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (g.lang_total + 5 * g.v)::HUGEINT AS q
  FROM g JOIN kept k ON k.lang = g.lang
       LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(max(s.value), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
                  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
       ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 50)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM parts
"""
