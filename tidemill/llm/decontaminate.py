"""Benchmark leaks by templates: slots for numbers, names and units, then slot consistency."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import parts_for, prepared, table
from tidemill.llm.words import LOWER, hash_spans, mix, mix1, raw_bytes, word_bounds

#: Template tokens in a window; words outside slots that a leak must have (all of an item with fewer).
WINDOW, LITERALS = 8, 4
#: Consecutive template tokens with consistent slots that make a leak (all of a shorter item).
RUN = 13
#: Characters of benchmark text whose windows a task holds at once; a larger benchmark takes more passes.
BLOCK_CHARS = 8_000_000

#: Units that become a slot.
UNITS = (
    "mm", "cm", "dm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards",
    "mi", "mile", "miles", "meter", "meters", "metre", "metres", "mg", "g", "kg", "oz", "lb", "lbs",
    "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ton", "tons", "ml", "cl", "l",
    "liter", "liters", "litre", "litres", "gallon", "gallons", "ms", "s", "sec", "second", "seconds",
    "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month",
    "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent",
    "mph", "kmh", "degree", "degrees",
)
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
_SLOT_HASH = np.array([0] + [mix1(1000 + k) for k in (NUMBER, NAME, UNIT)], dtype=np.uint64)

# Separators: ASCII punctuation and blanks; a point or comma inside a number belongs to it.
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[b for b in range(128) if not chr(b).isalnum()]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?:\n")] = True


def _word_hash(words) -> np.ndarray:
    raw, offsets = raw_bytes(pa.array(list(words)))
    starts, ends = word_bounds(raw, offsets)
    return np.sort(hash_spans(LOWER[raw], starts, ends))


_UNIT_HASHES = _word_hash(UNITS)


@dataclass
class Tokens:
    """Template tokens of some texts: ``first`` says where each text's begin."""

    template: np.ndarray  # what a window compares
    value: np.ndarray  # the word itself
    kind: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> tuple[Tokens, Tokens]:
    """The first two of ``views``."""
    return views(texts)[:2]


def views(texts: pa.Array) -> tuple[Tokens, Tokens, Tokens]:
    """Words with numbers, names and units as slots; the words as they are, without slots; and
    with slots where a word that begins a sentence can be a name too.

    A number is a run of digits, with points and commas inside. A name is a word
    with a capital (A-Z or a Latin-1 letter) then small letters that doesn't
    begin a sentence; names in a row are one slot. A unit is one of UNITS right
    after a number. Other words compare after lower-casing A-Z.
    """
    raw, offsets = raw_bytes(texts)
    split = raw.copy()
    digit = _DIGIT[raw]
    if len(raw) > 2:
        inner = np.zeros(len(raw), dtype=bool)
        inner[1:-1] = ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
        edges = offsets[(offsets > 0) & (offsets < len(raw))]
        inner[edges] = False
        inner[edges - 1] = False
    else:
        inner = np.zeros(len(raw), dtype=bool)
    split[_SEPARATOR[raw] & ~inner] = 32
    starts, ends = word_bounds(split, offsets)
    first = np.searchsorted(starts, offsets)
    value = hash_spans(LOWER[raw], starts, ends)
    plain = Tokens(value, value, np.zeros(len(value), np.int8), first)
    if not len(starts):
        return plain, plain, plain

    def count(mask, a, b):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[b] - total[a]

    letters = ends - starts
    number = count(digit | inner, starts, ends) == letters
    lead = raw[starts]
    after = raw[np.minimum(starts + 1, len(raw) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    small = count(_SMALL[raw], starts, ends) > 0
    begins = np.ones(len(starts), dtype=bool)
    begins[1:] = count(_STOP[raw] & ~inner, ends[:-1], starts[1:]) > 0
    inside = np.ones(len(starts), dtype=bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    unit = np.zeros(len(starts), dtype=bool)
    unit[1:] = number[:-1] & inside[1:] & np.isin(value[1:], _UNIT_HASHES)

    def slotted(name: np.ndarray) -> Tokens:
        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, WORD))).astype(np.int8)
        follows = np.zeros(len(starts), dtype=bool)
        follows[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & inside[1:] & ~begins[1:]
        keep = ~follows
        head = np.cumsum(keep) - 1
        joined = np.zeros(int(keep.sum()), dtype=np.uint64)
        np.add.at(joined, head, mix(value))
        new_first = np.concatenate([[0], np.cumsum(keep)])[first]
        kind = kind[keep]
        return Tokens(np.where(kind == WORD, joined, _SLOT_HASH[kind]), joined, kind, new_first)

    return slotted(capital & small & ~begins & inside), plain, slotted(capital & small)


def windows(found: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` tokens inside a text with a word among them, and where they begin."""
    n = len(found.template) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n)
    owner = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    words = np.concatenate([[0], np.cumsum(found.kind == WORD)])
    # A whole short item says little: it must be words for the most part.
    good = (owner[:n] == owner[size - 1:]) & (words[size:] - words[:n] >= (1 if size == WINDOW else min(LITERALS, size)))
    at = at[good]
    out = np.full(len(at), mix1(size), dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xA0761D6478BD642F) + found.template[at + k]
    return mix(out), at


class Benchmark:
    """Items of a benchmark ready to be looked for. An item shorter than a window is one window.

    Each is held in three views (``views``): copies in other capitals or with other
    breaks have other slots, but the same words; names may begin sentences.
    """

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.views = [View(found) for found in views(pa.array(texts, pa.string()))]

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, float, bool]]:
        """(text, item, tokens in the longest run, its share of the item, same slots) of every leak."""
        best: dict[tuple[int, int], tuple[int, float, bool]] = {}
        for view, own in zip(self.views, views(texts), strict=True):
            for text, item, run, share, same in view.find(own):
                found = (share, run, same)
                best[text, item] = max(best.get((text, item), found), found)
        return [(text, item, run, share, same) for (text, item), (share, run, same) in sorted(best.items())]


class View:
    def __init__(self, found: Tokens):
        self.tokens = found
        lengths = np.diff(found.first)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({WINDOW, *(int(x) for x in lengths if 0 < x < WINDOW)}):
            hashes, at = windows(found, size)
            if size < WINDOW:
                whole = lengths[self.owner[at]] == size
                hashes, at = hashes[whole], at[whole]
            order = np.argsort(hashes, kind="stable")
            self.index[size] = hashes[order], at[order]

    def find(self, own: Tokens) -> list[tuple[int, int, int, float, bool]]:
        owner = np.repeat(np.arange(len(own.first) - 1), np.diff(own.first))
        matched: dict[tuple[int, int, int], set] = {}
        for size, (known, places) in self.index.items():
            hashes, at = windows(own, size)
            low = np.searchsorted(known, hashes)
            hit = np.flatnonzero((low < len(known)) & (known[np.minimum(low, len(known) - 1)] == hashes)) if len(known) else []
            for i in hit:
                high = np.searchsorted(known, hashes[i], side="right")
                for place in places[low[i]:high]:
                    run = (int(owner[at[i]]), int(self.owner[place]), int(at[i] - place))
                    matched.setdefault(run, set()).update(range(int(place), int(place) + size))
        out = []
        for (text, item, shift), covered in matched.items():
            length = int(self.tokens.first[item + 1] - self.tokens.first[item])
            words = int((self.tokens.kind[self.tokens.first[item]:self.tokens.first[item + 1]] == WORD).sum())
            run, same = self._consistent(sorted(covered), own, shift, min(LITERALS, words))
            if run >= min(RUN, length):
                out.append((text, item, run, run / length, same))
        return out

    def _consistent(self, places: list[int], own: Tokens, shift: int, least: int) -> tuple[int, bool]:
        """The longest run of neighbouring tokens, ``least`` words among them, whose slots stand for each other one to one.

        Where a slot stands for another value than before, the run goes on from behind its earlier place.
        """
        longest, best_same = 0, False
        there: dict = {}
        back: dict = {}
        begin, last, unlike = 0, None, -1
        words: list[int] = []
        for place in places:
            kind, a, b = self.tokens.kind[place], self.tokens.value[place], own.value[place + shift]
            if last is None or place != last + 1:
                there, back, begin, words = {}, {}, place, []
            if kind == WORD:
                words.append(place)
            else:
                for known, key, value in ((there, (kind, a), b), (back, (kind, b), a)):
                    before, at = known.get(key, (value, -1))
                    if before != value and at >= begin:
                        begin = at + 1
                    known[key] = value, place
            unlike, last = unlike if a == b else place, place
            found = (place - begin + 1, unlike < begin)
            if found > (longest, best_same) and len(words) - bisect_left(words, begin) >= least:
                longest, best_same = found
        return longest, best_same


def blocks(items: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in blocks of about BLOCK_CHARS characters, by a hash of the item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = parts_for(int(chars), BLOCK_CHARS)
    for block in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).orderBy("item_id", "text")
        rows = part.collect()
        yield Benchmark([r.item_id for r in rows], [r.text for r in rows])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, run, coverage, same_slots): documents that hold a benchmark item.

    Whole texts are read as template tokens and as plain words (``views``). Windows of WINDOW tokens are
    hash-joined with the benchmark's; windows that follow each other form runs, in
    which a slot's value in the item must stand for one value in the document and
    back. A run of RUN tokens, or of all of a shorter item, with LITERALS words outside slots is a leak; ``same_slots``
    tells copies from re-parameterised questions. Null and empty texts on either
    side match nothing; repeated rows are reported each; other columns are
    ignored. An empty benchmark or table gives no rows.
    """
    prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks(items):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = block.find(batch.column("text"))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([block.ids[f[1]] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64()),
                    pa.array([f[4] for f in found], pa.bool_())],
                    ["doc_id", "item_id", "run", "coverage", "same_slots"])
        part = docs.mapInArrow(run, "doc_id long, item_id long, run long, coverage double, same_slots boolean")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all their columns as they were."""
    prepared(docs.sparkSession)
    for block in blocks(items):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[f[0] for f in block.find(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
