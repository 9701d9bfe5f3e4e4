"""Fuzzy duplicate lines: shared runs of words, bags of words, edit similarity, one occurrence per group."""

from __future__ import annotations

from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import parts_for, prepared, runs_of, stage, table
from tidemill.llm.components import components
from tidemill.llm.near_dedup import link_batch, text_hash
from tidemill.llm.words import hash_spans, mix, raw_bytes, word_bounds

#: Lines of fewer words are left alone: blank lines and rules have none.
MIN_WORDS = 1
#: SimHashes of lines at SIMILARITY lie far apart (about 13 of 64 bits, more where words repeat),
#: so every distance is let through: they don't decide.
DISTANCE = 64
#: Share of words that an edit script leaves alone.
SIMILARITY = 0.8
#: Longest run of words that similar lines are sure to share, whatever their length.
RUN = 4
#: Lines up to this length are found by all their runs; of longer ones about so many runs count.
RUNS = 48
#: Runs of a part, which are sorted at once, and parts that go to a task: many small ones even out.
PART_RUNS, TASK_PARTS = 750_000, 4
#: Runs that a task holds before it deals them out to the parts, more at most than one batch has.
HELD_RUNS = 1_000_000
#: Bytes of a line's bag of words, each bit the parity of the words that hash to it.
BINS = 64
#: Lines of a bucket that one task compares with each other.
BLOCK = 1024
#: Rows of whole blocks that are compared at once.
BLOCK_ROWS = 4096
#: Members of a bucket up to which they are compared without arrays of their own, and lines of a
#: larger one that are compared at once with those of like length.
FEW, STRIP = 12, 128

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[[b for b in range(128) if b != 10 and not chr(b).isalnum()]] = 32
CLEAN = _CLEAN.tobytes()


def clean_words(line: bytes) -> list[bytes]:
    """A line's words: A-Z lower-cased, ASCII punctuation and blanks between words."""
    return line.translate(CLEAN).split()


def line_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; a text has one line more than line feeds."""
    feeds = np.flatnonzero(raw == 10)
    text = np.searchsorted(offsets, feeds, side="right") - 1
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    owner = np.sort(np.concatenate([np.arange(len(offsets) - 1), text]), kind="stable")
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) if len(owner) else []
    ends[last] = offsets[owner[last] + 1] if len(owner) else 0
    return starts, ends, owner


def simhashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each run of word hashes: the majority of their bits, 0 on a tie.

    Eight bits are counted at a time, one in each byte of a word; a stretch of 255 words
    can't overflow a byte, longer runs are counted in several.
    """
    counts = np.diff(first)
    parts = -(-counts // 255)
    run = np.repeat(np.arange(len(counts)), parts)
    begin = first[:-1][run] + 255 * (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts))
    sums = np.zeros((len(run), 8, 8), dtype=np.int32)  # part, byte, bit
    if len(run):
        for bit in range(8):
            lanes = (words >> np.uint64(bit)) & np.uint64(0x0101010101010101)
            sums[:, :, bit] = np.add.reduceat(lanes, begin).view(np.uint8).reshape(-1, 8)
    total = sums.reshape(-1, 64)
    if len(run) != len(counts):
        total = np.zeros((len(counts), 64), dtype=np.int64)
        np.add.at(total, run, sums.reshape(-1, 64))
    major = total * 2 > counts[:, None]
    return np.packbits(major, axis=1, bitorder="little").reshape(-1, 8).copy().view(np.uint64).reshape(-1)


def lines_of(texts: pa.Array, sims: bool = True) -> dict[str, np.ndarray]:
    """Lines of at least MIN_WORDS words: text, line (number in it), words, key (2 longs), place, the
    hashes of their words with each line's first; with ``sims`` their SimHashes too."""
    raw, offsets = raw_bytes(texts)
    starts, ends, owner = line_bounds(raw, offsets)
    clean = _CLEAN[raw]
    word_starts, word_ends = word_bounds(clean, offsets)
    hashes = hash_spans(clean, word_starts, word_ends)
    first = np.searchsorted(word_starts, np.append(starts, len(raw)))
    counts = np.diff(first)
    number = np.arange(len(starts)) - np.searchsorted(owner, owner)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
    keep = counts >= MIN_WORDS
    word_kept = np.repeat(keep, counts)
    hashes, place, counts = hashes[word_kept], place[word_kept], counts[keep]
    begin = np.concatenate([[0], np.cumsum(counts)])
    placed = mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if len(placed):
        keys = np.stack([np.add.reduceat(placed, begin[:-1]), np.add.reduceat(mix(placed + np.uint64(5)), begin[:-1])], axis=1)
    else:
        keys = np.zeros((0, 2), np.uint64)
    out = {"text": owner[keep], "line": number[keep], "words": counts, "key": keys, "start": starts[keep],
           "end": ends[keep], "hashes": hashes, "first": begin}
    return out | {"sim": simhashes(hashes, begin)} if sims else out


def most_edits(words):
    """Edits that leave SIMILARITY of the longer line's words alone."""
    return np.floor((1 - SIMILARITY) * words + 1e-9).astype(np.int64)


def run_sizes(words: int) -> list[int]:
    """The sizes of the runs by which a line of so many words finds its partners.

    k edits part the words they leave alone into k + 1 runs at most, so that two
    lines of ``longer`` words and fewer share a run of (longer - k) / (k + 1) words, rounded up.
    """
    sizes, longer = set(), words
    while words and longer - most_edits(longer) <= words:
        k = int(most_edits(longer))
        if k:
            sizes.add(min(RUN, -(-(longer - k) // (k + 1))))
        if longer >= 16:  # from here on all share RUN
            break
        longer += 1
    return sorted(sizes)


_SIZES = [run_sizes(n) for n in range(17)]


def _numbered(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The values; the n-th occurrence of one with the same owner is a value of its own."""
    mixed = mix(values + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed)
    ordered = mixed[order]
    again = ordered[1:] == ordered[:-1]
    if not again.any():
        return values
    # Few repeat: only those are put in order with their owners.
    at = np.sort(order[np.append(again, False) | np.append(False, again)])
    at = at[np.lexsort((values[at], owner[at]))]
    value, line = values[at], owner[at]
    begin = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (line[1:] != line[:-1])]))
    times = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    out = values.copy()
    out[at] = np.where(times > 0, mix(value + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), value)
    return out


def runs_in(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of the runs by which lines meet.

    The n-th occurrence of a run in a line is a run of its own, so that repeated
    words count as often as they stand there. Lines of up to RUNS words have all
    their runs. Longer ones have those with the smallest hashes, by a limit that
    falls with their length: what two lines share below the lower limit, both have.
    """
    hashes, first, words = found["hashes"], found["first"], found["words"]
    line_of = np.repeat(np.arange(len(words)), words)
    end = first[1:][line_of]
    length = np.minimum(words, 16)[line_of]
    every, owners = [], []
    for size in range(1, RUN + 1):
        has = np.array([size in sizes for sizes in _SIZES])
        at = np.flatnonzero(has[length] & (np.arange(len(hashes)) + size <= end))
        run = np.full(len(at), size, dtype=np.uint64)
        for k in range(size):
            run = run * np.uint64(0xA0761D6478BD642F) + hashes[at + k]
        every.append(mix(run))
        owners.append(line_of[at])
    run, owner = np.concatenate(every), np.concatenate(owners)
    run = _numbered(run, owner)
    share = np.minimum(RUNS / words, 1.0)[owner]
    keep = (share >= 1) | ((run >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share)
    return run[keep], owner[keep]


def bags_of(found: dict[str, np.ndarray]) -> np.ndarray:
    """BINS bytes for each line, each bit the parity of the words that hash to it.

    The n-th occurrence of a word counts as a word of its own: one word more or less
    changes one bit.
    """
    lines = np.repeat(np.arange(len(found["words"])), found["words"])
    bit = mix(_numbered(found["hashes"], lines)) % np.uint64(8 * BINS)
    bags = np.zeros(len(found["words"]) * (BINS // 8), dtype=np.uint64)
    np.bitwise_xor.at(bags, lines * (BINS // 8) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return bags.view(np.uint8).reshape(-1, BINS)


def bins_of(bags: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bags), dtype=np.int8).reshape(-1, BINS)


def _names(keys: np.ndarray, width: int = 16) -> pa.Array:
    flat = pa.py_buffer(np.ascontiguousarray(keys).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(keys), [None, flat]).cast(pa.binary())


def _marks(keys: np.ndarray) -> np.ndarray:
    """A line's key in 48 bits. Lines that share one are both candidates."""
    return keys[:, 0] >> np.uint64(16)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = lines_of(batch.column("text"), sims=False)
        rows = pa.array(found["text"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows),
             pa.array(found["line"], pa.int32()), _names(found["key"]),
             pa.array(_marks(found["key"]).view(np.int64)), pa.array(found["words"], pa.int32()),
             _names(bags_of(found), BINS)],
            ["doc_id", "text_hash", "line", "key", "mark", "words", "bag"])


def _packed(values: np.ndarray, edges: np.ndarray, width: int) -> list[bytes]:
    """For each stretch of the numbers their lowest bytes, first all lowest ones, then all the next:
    of sorted numbers the highest bytes are alike, so they compress."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return [planes[:, low:high].tobytes() for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _unpacked(pieces: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((sum(map(len, pieces)) // width, 8), dtype=np.uint8)
    at = 0
    for piece in pieces:
        planes = np.frombuffer(piece, dtype=np.uint8).reshape(width, -1)
        out[at:at + planes.shape[1], :width] = planes.T
        at += planes.shape[1]
    return out.view(np.uint64).reshape(-1)


def _distinct(found: dict[str, np.ndarray], seen: np.ndarray) -> dict[str, np.ndarray]:
    """The lines of a batch, equal ones once and those seen before not at all."""
    once = np.sort(np.unique(found["key"][:, 0], return_index=True)[1])
    once = once[~np.isin(found["key"][once, 0], seen)]
    kept = np.zeros(len(found["words"]), dtype=bool)
    kept[once] = True
    words = found["words"][once]
    return {"words": words, "key": found["key"][once], "hashes": found["hashes"][np.repeat(kept, found["words"])],
            "first": np.concatenate([[0], np.cumsum(words)])}


def _runs(parts: int):
    """Per part of the runs, those of some batches and the marks of their lines, packed.

    A part holds some PART_RUNS, so that four bytes tell nearly all of its runs apart; lines
    that meet by chance are looked at like any others.
    """
    def dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        # Mixed once more: of long lines the runs with small hashes are here, which would go to the first parts.
        spread, marks = mix(np.concatenate([x[0] for x in held])), np.concatenate([x[1] for x in held])
        part = ((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        sorting = (part << np.uint64(32)) | (spread & np.uint64(0xFFFFFFFF))
        order = np.argsort(sorting)
        sorting, marks = sorting[order], marks[order]
        edges = np.searchsorted(sorting, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
        some = np.flatnonzero(np.diff(edges))
        edges = np.append(edges[some], edges[-1])
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(_packed(sorting, edges, 4), pa.binary()),
             pa.array(_packed(marks, edges, 6), pa.binary())], ["part", "runs", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, many = [], np.zeros(0, np.uint64), 0
        for batch in batches:
            found = _distinct(lines_of(batch.column("text"), sims=False), seen)
            runs, owner = runs_in(found)
            held.append((runs, _marks(found["key"])[owner]))
            seen, many = np.append(seen, found["key"][:, 0]), many + len(runs)
            if many >= HELD_RUNS:
                yield dealt(held)
                held, seen, many = [], seen[:0], 0
        if many:
            yield dealt(held)
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines, by mark, of the runs of a part that several have. A bucket is named by its
    lines, so that runs of the same lines are one bucket; ``m`` is their number."""
    for group in runs_of(batches, ["part"]):
        runs, marks = (_unpacked(group.column(n).to_pylist(), width) for n, width in (("runs", 4), ("marks", 6)))
        # Most runs stand once: only the others are put in order with their lines.
        order = np.argsort(runs)
        ordered = runs[order]
        again = ordered[1:] == ordered[:-1]
        order = order[np.append(again, False) | np.append(False, again)] if len(runs) else order
        order = order[np.lexsort((marks[order], runs[order]))]
        runs, marks = runs[order], marks[order]
        new = np.ones(len(runs), dtype=bool)
        new[1:] = (runs[1:] != runs[:-1]) | (marks[1:] != marks[:-1])
        runs, marks = runs[new], marks[new]
        begin = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else np.zeros(0, np.int64)
        m = np.diff(np.append(begin, len(runs)))
        marks, m = marks[np.repeat(m > 1, m)], m[m > 1]
        if not len(m):
            continue
        bucket = mix(np.add.reduceat(mix(marks + np.uint64(1)), np.cumsum(m) - m) + m.astype(np.uint64))
        once = np.zeros(len(m), dtype=bool)
        once[np.unique(bucket, return_index=True)[1]] = True
        marks, bucket, m = marks[np.repeat(once, m)], bucket[once], m[once]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(bucket, m).view(np.int64)), pa.array(marks.view(np.int64)), pa.array(np.repeat(m, m))],
            ["bucket", "mark", "m"])


def _chosen_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cleaned words of the lines asked for in ``wanted``."""
    for batch in batches:
        out = [(w["key"], b" ".join(clean_words(lines[w["line"]])))
               for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)
               for lines in [text.encode().split(b"\n")] for w in wanted]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], pa.binary()) for i in range(2)], ["key", "content"])


def _room(words: np.ndarray, bins: np.ndarray, other_words: np.ndarray, other_bins: np.ndarray) -> np.ndarray:
    """How many bits more the bags of one and the other side could differ in; below 0 if lines aren't similar.

    A replacement changes two bits at most, an insertion or a deletion one, and there are as
    many of these as the lengths differ.
    """
    apart = np.zeros(np.broadcast_shapes(words.shape, other_words.shape), dtype=np.int16)
    own, other = (np.ascontiguousarray(x).view(np.uint64) for x in (bins, other_bins))
    for at in range(own.shape[-1]):
        apart += np.bitwise_count(own[..., at] ^ other[..., at])
    most, longer = most_edits(np.maximum(words, other_words)), np.abs(words - other_words)
    return np.where(longer <= most, np.minimum(2 * most - longer - apart, 32767), -1).astype(np.int16)


def _may(words: np.ndarray, bins: np.ndarray, other_words: np.ndarray, other_bins: np.ndarray) -> np.ndarray:
    """Which lines of one and the other side their lengths and bags allow to be similar."""
    return _room(words, bins, other_words, other_bins) >= 0


def _matrix(words: np.ndarray, bins: np.ndarray) -> np.ndarray:
    may = _may(words[:, None], bins[:, None], words[None, :], bins[None, :])
    np.fill_diagonal(may, False)
    return may


def _close(words: np.ndarray, bins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i before j: the lines of each block that their lengths and bags allow to be similar."""
    return _with_room(words, bins, sizes)[:2]


def _with_room(words: np.ndarray, bins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of ``_close``, and the room of each."""
    begin, group = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    first, second, rooms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]
    # Small blocks all at once, by how far apart two members stand.
    inside = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW), sizes))
    for apart in range(1, FEW):
        inside = inside[inside + apart < len(words)]
        inside = inside[group[inside] == group[inside + apart]]
        if not len(inside):
            break
        i = inside[np.abs(words[inside] - words[inside + apart]) <= most_edits(np.maximum(words[inside], words[inside + apart]))]
        room = _room(words[i], bins[i], words[i + apart], bins[i + apart])
        i = i[room >= 0]
        first.append(i)
        second.append(i + apart)
        rooms.append(room[room >= 0])
    for at, size in zip(begin[sizes > FEW], sizes[sizes > FEW], strict=True):
        own = slice(at, at + size)
        if size <= STRIP:
            room = _room(words[own][:, None], bins[own][:, None], words[own][None], bins[own][None])
            i, j = np.nonzero(np.triu(room >= 0, 1))
            first.append(at + i)
            second.append(at + j)
            rooms.append(room[i, j])
            continue
        order = at + np.argsort(words[own], kind="stable")
        lengths = words[order]
        for low in range(0, size, STRIP):
            mine = order[low:low + STRIP]
            # No partner has more than 1 / SIMILARITY times the words.
            other = order[low:np.searchsorted(lengths, lengths[low + len(mine) - 1] / SIMILARITY + 2)]
            room = _room(words[mine][:, None], bins[mine][:, None], words[other][None], bins[other][None])
            i, j = np.nonzero(np.triu(room >= 0, 1))
            first.append(np.minimum(mine[i], other[j]))
            second.append(np.maximum(mine[i], other[j]))
            rooms.append(room[i, j])
    return np.concatenate(first), np.concatenate(second), np.concatenate(rooms)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole blocks of buckets, sorted, and how many rows each has. Holds one block, or BLOCK_ROWS of several, and one batch."""
    names = ["bucket", "low", "high"]
    held: list[pa.RecordBatch] = []

    def ended() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        new = np.ones(rows.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (rows.column(n).to_numpy() for n in names)])
        return rows, np.diff(np.append(np.flatnonzero(new), rows.num_rows))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy() for n in names]
        last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns]))
        begin = int(last[-1]) + 1 if len(last) else 0
        if begin:
            held.append(batch.slice(0, begin))
        border = held and (begin or any(held[-1].column(n)[-1] != batch.column(n)[0] for n in names))
        if border and sum(x.num_rows for x in held) >= BLOCK_ROWS:
            yield ended()
            held = []
        held.append(batch.slice(begin))
    if held:
        yield ended()


def _tree(n: int, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a spanning forest over n lines, of those whose bags are most alike for their lengths."""
    order = np.argsort(-room, kind="stable")
    i, j = i[order], j[order]
    head = np.arange(n)
    chosen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        a, b = head[i], head[j]
        apart = a != b
        if not apart.any():
            return np.concatenate(chosen[0]), np.concatenate(chosen[1])
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        # Each head but the smallest of its neighbours goes to a smaller one, by the first pair that has one.
        high, low = np.maximum(a, b), np.minimum(a, b)
        by = np.full(len(head), -1)
        by[high[::-1]] = np.arange(len(high))[::-1]
        by = by[by >= 0]
        chosen[0].append(i[by])
        chosen[1].append(j[by])
        head[high[by]] = low[by]
        while (head != (over := head[head])).any():
            head = over


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each block of a bucket that may be similar to another one of it; ``a`` and ``b``
    are the pairs of a spanning forest, one less than lines that hang together."""
    for rows, sizes in _blocks(batches):
        words, bins = rows.column("words").to_numpy().astype(np.int64), bins_of(rows.column("bag").to_pylist())
        i, j, room = _with_room(words, bins, sizes)
        found = np.zeros(rows.num_rows, dtype=bool)
        found[i] = found[j] = True
        i, j = _tree(rows.num_rows, i, j, room)
        # A pair stands in the row of one of its lines or, like most rows, of another one: rows are more than pairs.
        ends = np.full((2, rows.num_rows), -1)
        group = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(group[i], kind="stable")
        i, j = i[order], j[order]
        free = np.flatnonzero(found)
        rank = np.arange(len(i)) - np.searchsorted(group[i], group[i])
        at = free[np.searchsorted(group[free], group[i]) + rank]
        ends[:, at] = i, j
        key = rows.column("key").combine_chunks()
        out = rows.select(["bucket", "low", "high", "key"]).filter(pa.array(found)).combine_chunks()
        pairs = [key.take(pa.array(x, mask=x < 0)).filter(pa.array(found)) for x in ends]
        yield pa.RecordBatch.from_arrays(
            [*(c.combine_chunks() for c in out.columns), *pairs], [*out.schema.names, "a", "b"])


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each block that may be similar to one of it that lies in another group so far."""
    names = ["bucket", "low", "high", "key", "words", "bag", "component"]
    for rows, sizes in _blocks(batches):
        i, j = _strangers(rows, sizes)[:2]
        found = np.zeros(rows.num_rows, dtype=bool)
        found[i] = found[j] = True
        yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in rows.select(names).filter(pa.array(found)).columns], names)


def _strangers(rows: pa.Table, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j) of the rows of each block that may be similar and lie in two groups, and every row's group."""
    _, group = np.unique(rows.column("component").to_numpy(zero_copy_only=False), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    mixed = np.add.reduceat(group != np.repeat(group[begin], sizes), begin) > 0
    at = np.flatnonzero(np.repeat(mixed, sizes))
    some = rows.take(pa.array(at))
    i, j = _close(some.column("words").to_numpy().astype(np.int64), bins_of(some.column("bag").to_pylist()), sizes[mixed])
    i, j = at[i], at[j]
    apart = group[i] != group[j]
    return i[apart], j[apart], group


def _numbered_words(words: list[bytes]) -> frozenset:
    """The words, the n-th occurrence of one as a word of its own."""
    if len(once := frozenset(words)) == len(words):
        return once
    times: dict[bytes, int] = {}
    out = set()
    for word in words:
        n = times[word] = times.get(word, 0) + 1
        out.add((word, n) if n > 1 else word)
    return frozenset(out)


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of similar lines that join the groups of each block: one less than there are groups at most."""
    for rows, sizes in _blocks(batches):
        i, j, group = _strangers(rows, sizes)
        block = np.repeat(np.arange(len(sizes)), sizes)
        key, content = (rows.column(n).to_pylist() for n in ("key", "content"))
        words: dict[int, list[bytes]] = {}
        bags: dict[int, frozenset] = {}
        heads: dict[tuple[int, int], tuple[int, int]] = {}

        def head(x: int) -> tuple[int, int]:
            own = at = (int(block[x]), int(group[x]))
            while (over := heads.get(at, at)) != at:
                at = over
            if own != at:
                heads[own] = at
            return at

        found = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            one, other = head(x), head(y)
            if one == other:
                continue
            for z in (x, y):
                if z not in words:
                    words[z] = content[z].split(b" ")
                    bags[z] = _numbered_words(words[z])
            # Every word of the longer line that the other one lacks takes an edit; most pairs end here.
            longer = max(len(words[x]), len(words[y]))
            if longer - len(bags[x] & bags[y]) <= (1 - SIMILARITY) * longer + 1e-9 and similar(words[x], words[y]):
                heads[one] = other
                found.append((key[x], key[y]))
        yield link_batch(found)


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and replacements between two sequences, bit-parallel over one of them."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low:len(a) - high], b[low:len(b) - high]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(right_up & top) - bool(right_down & top)
        right_up = (right_up << 1 | 1) & full
        up = (right_down << 1 & full) | (full & ~(diagonal | right_up))
        down = right_up & diagonal
    return score


def similar(a: list, b: list) -> bool:
    most = (1 - SIMILARITY) * max(len(a), len(b)) + 1e-9
    if abs(len(a) - len(b)) > most:  # as many insertions at least
        return False
    if len(a) == len(b) and sum(map(ne, a, b)) <= most:  # replacements that do
        return True
    return edit_distance(a, b) <= most


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of lines whose words are similar."""
    for batch in batches:
        rows = zip(*(batch.column(n).to_pylist() for n in ("a", "b", "words_a", "words_b")), strict=True)
        yield link_batch([(a, b) for a, b, own, other in rows if similar(own.split(b" "), other.split(b" "))])


def confirmed(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """Links (a, b): those of the pairs that are similar, each looked at once.

    The parts are as many as the session names: pairs are small, and looking at them takes long.
    """
    for side in ("a", "b"):
        pairs = pairs.join(contents.select(F.col("key").alias(side), F.col("content").alias(f"words_{side}")), side)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, "a", "b").mapInArrow(_linked, "a binary, b binary")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, lines): for every document that has some, the numbers of the lines to drop.

    Lines part at line feeds and are compared by ``clean_words``; those without a
    word never go. Two lines link when their words are the same,
    or when their edit similarity, in words, is SIMILARITY or more. Of every connected group the
    occurrence with the smallest (id, hash of the text, line number) stays, null
    ids last. Rows that repeat id and text are one document. Null and empty
    texts have no lines; other columns are ignored.

    Equal lines fold first, with partial sums, so a line that a third of the
    documents share is one entry. Similar lines share a run of words (``run_sizes``): runs
    travel packed, and only those of several lines become rows, staged so that the runs are gone before the joins. Buckets of the same lines
    count once, large ones are dealt out in blocks; only lines whose length and bag of words
    allow a partner in their block go on. Verification takes two rounds, and no round makes more
    rows than the blocks have lines: first a spanning forest of every block, by the bags
    most alike, which joins nearly all of a group; then the lines that may have a partner in another
    group meet with their words, and each block hands on the links that join its groups. Lines of up
    to RUNS words miss no partner; of longer ones a share of the runs, by hash, is looked
    at, and a pair is missed with a chance of 6e-5 at the worst spread of edits.
    """
    prepared(docs.sparkSession)
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"),
                         F.coalesce(text_col, F.lit("")).alias("text"))
    lines = stage(marked.mapInArrow(
        _occurrences, "doc_id long, text_hash long, line int, key binary, mark long, words int, bag binary"), "lines")
    total = lines.agg(F.sum(F.least("words", F.lit(RUNS)))).first()[0] or 0
    parts = parts_for(int(total), PART_RUNS)
    shared = stage(marked.select("text").mapInArrow(_runs(parts), "part int, runs binary, marks binary")
                   .repartition(parts_for(parts, TASK_PARTS), "part").sortWithinPartitions("part")
                   .mapInArrow(_shared, "bucket long, mark long, m long").distinct(), "shared")
    # A key has one mark, one length and one bag.
    unique = stage(lines.groupBy("key", "mark", "words", "bag").agg(F.count("*").alias("times")), "unique")
    in_bucket = (shared.join(unique.select("key", "mark", "words", "bag"), "mark")
                 .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = (in_bucket.select("bucket", "key", "words", "bag", block.alias("block"),
                              F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "key", "words", "bag"))
    order = ["bucket", "low", "high"]
    likely = stage(dealt.repartition(*order).sortWithinPartitions(*order, "key")
                   .mapInArrow(_likely, "bucket long, low int, high int, key binary, a binary, b binary"), "likely")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "line")
    active = likely.select("key").distinct()
    wanted = (lines.join(active, "key", "left_semi").groupBy("key").agg(F.min(place).alias("first"))
              .groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
              .agg(F.collect_list(F.struct("key", F.col("first.line").alias("line"))).alias("wanted")))
    same = marked["doc_id"].eqNullSafe(wanted["doc_id"]) & (marked["text_hash"] == wanted["text_hash"])
    contents = stage(marked.join(wanted, same).select("text", "wanted")
                     .mapInArrow(_chosen_lines, "key binary, content binary")
                     .groupBy("key").agg(F.any_value("content").alias("content")), "line-words")
    nearest = likely.filter("a is not null").select("a", "b").distinct()
    joined = stage(components(confirmed(nearest, contents)), "line-groups")
    so_far = unique.join(active, "key", "left_semi").join(joined, F.col("key") == F.col("node"), "left").select(
        "key", "words", "bag", F.coalesce("component", "key").alias("component"))
    parted = (likely.drop("a", "b").join(so_far, "key").repartition(*order).sortWithinPartitions(*order, "key")
              .mapInArrow(_parted, "bucket long, low int, high int, key binary, words int, bag binary, component binary"))
    # Rows are few here, and looking at them takes long.
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = (parted.join(contents, "key").repartition(many, *order).sortWithinPartitions(*order, "key")
              .mapInArrow(_joining, "a binary, b binary").distinct())
    links = confirmed(parted, contents).unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
    reached = stage(components(links), "line-groups")
    groups = (unique.select("key", "times").join(reached, F.col("key") == F.col("node"), "left")
              .filter("component is not null or times > 1").select("key", F.coalesce("component", "key").alias("component")))
    repeated = stage(lines.join(groups, "key").select("component", place.alias("place")), "repeated")
    kept = repeated.groupBy("component").agg(F.min("place").alias("first"))
    return (repeated.join(kept, "component").filter(~F.col("place").eqNullSafe(F.col("first")))
            .groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.text_hash").alias("text_hash"))
            .agg(F.collect_set("place.line").alias("lines")))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, gone = [], [], []
        for text, lines in zip(batch.column("text").to_pylist(), batch.column("__lines").to_pylist(), strict=True):
            parts = (text or "").split("\n")
            drop = set(lines or ())
            texts.append("\n".join(p for i, p in enumerate(parts) if i not in drop) if drop else text)
            counts.append(len(parts))
            gone.append(len(drop))
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, "text", pa.array(texts, pa.string()))
        batch = batch.remove_column(batch.schema.get_field_index("__lines"))
        yield batch.append_column("__n", pa.array(counts, pa.int64())).append_column("__gone", pa.array(gone, pa.int64()))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines, all columns, with ``__n`` and ``__gone``:
    how many lines each had and lost. Needs columns doc_id and text."""
    drops = repeated_lines(docs).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
                                        F.col("lines").alias("__lines"))
    same = docs["doc_id"].cast("long").eqNullSafe(drops["__id"]) & (text_hash(docs["text"]) == drops["__hash"])
    joined = docs.join(drops, same, "left").drop("__id", "__hash")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_without, fields + ", __n long, __gone long")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs).select(
        "doc_id", "text", F.col("__n").alias("n_lines"), F.col("__gone").alias("n_dropped"))
