import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from tidemill.llm import line_dedup as ld
from tidemill.llm.common import table  # noqa: F401


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 12))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 12))]
        assert ld.edit_distance(a, b) == distance(a, b)


def sim_of(line):
    return int(ld.lines_of(pa.array([line]))["sim"][0])


def brute(pairs):
    """(id, text that stays) of every document."""
    lines = sorted({(i is None, i, n, tuple(ld.clean_words(line.encode())))
                    for i, t in pairs for n, line in enumerate((t or "").split("\n"))
                    if len(ld.clean_words(line.encode())) >= ld.MIN_WORDS}, key=str)
    lines.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    sims = [sim_of((b" ".join(x[3])).decode()) for x in lines]
    group = list(range(len(lines)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i][3], lines[j][3]
            if a == b or (bin(sims[i] ^ sims[j]).count("1") <= ld.DISTANCE and ld.similar(list(a), list(b))):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    drop = {(lines[i][1], lines[i][2]) for i in range(len(lines)) if root(i) != i}
    return sorted(((i, None if t is None else "\n".join(
        x for n, x in enumerate(t.split("\n")) if (i, n) not in drop)) for i, t in pairs), key=str)


def fuzzy(seed):
    rng = random.Random(seed)
    bases = [words(rng, 40) for _ in range(8)]
    pairs = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(1, 5)):
            line = rng.choice(bases).split()
            if rng.random() < 0.5:
                line[rng.randrange(40)] = rng.choice(["Edited", "w1", "12", "99"])
            text.append(" ".join(line) if rng.random() < 0.8 else words(rng, rng.randrange(1, 9)))
        pairs.append((i, "\n".join(text)))
    return pairs


CASES = {
    "empty": [],
    "edges": [(1, None), (2, ""), (3, "\n\n"), (4, "short line\nshort line"), (5, "one two three four five\n\nOne, two; three four FIVE!"),
              (6, "x\none two three four five"), (None, "one two three four five\nalone in this line here"),
              (7, "page 1 of the whole long book"), (8, "page 27 of the whole long book"), (8, "page 27 of the whole long book"),
              (9, "a long text " * 20_000)],
    "copies": [(i, "the very same line of words\n" + f"and one own line number {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)],
    "fuzzy": fuzzy(2),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force(docs, name):
    source = docs(CASES[name])
    got = ld.without_repeated_lines(source)
    assert got.columns == source.columns + ["__n", "__gone"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute(CASES[name])


def test_small_blocks_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 2)
    got = ld.without_repeated_lines(docs(CASES["fuzzy"])).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(CASES["fuzzy"])


def test_lines_follow_split():
    texts = ["", "a", "a\nb", "\n", "a\n\nb c\n", None]
    from tidemill.llm.words import raw_bytes
    raw, offsets = raw_bytes(pa.array(texts))
    starts, ends, owner = ld.line_bounds(raw, offsets)
    got = [(o, raw[s:e].tobytes().decode()) for s, e, o in zip(starts, ends, owner, strict=True)]
    assert got == [(i, line) for i, t in enumerate(texts) for line in (t or "").split("\n")]


def test_simhash_is_the_majority():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**64, 50, dtype=np.uint64)
    first = np.array([0, 1, 4, 50])
    got = ld.simhashes(hashes, first)
    for n, (i, j) in enumerate(zip(first[:-1], first[1:], strict=True)):
        bits = np.unpackbits(hashes[i:j].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
        assert np.packbits(bits * 2 > j - i).tobytes() == got[n:n + 1].tobytes()

def edited(rng, line, edits):
    """The line after so many replacements, insertions and deletions at random places."""
    line = list(line)
    for n in range(edits):
        at = rng.randrange(len(line))
        line[at:at + 1] = rng.choice([[f"new{n}"], [f"new{n}", line[at]], [], [f"new{n}"]])
    return line


def pairs_at(rng, lengths, copies):
    """Pairs of lines at the similarity or above, with as many edits as it allows or fewer."""
    out = []
    while len(out) < len(lengths) * copies:
        n = lengths[len(out) % len(lengths)]
        base = [f"v{rng.randrange(10**9)}" for _ in range(n)]
        other = edited(rng, base, rng.randrange(1, max(2, n // 5 + 1)))
        if base != other and ld.similar(base, other):
            out.append((base, other))
    return out


def test_lines_at_the_similarity_are_found(docs):
    """Against brute force without any gate: one changed word to a fifth of the words."""
    rng = random.Random(7)
    pairs = pairs_at(rng, [6, 7, 8, 10, 12, 15, 16, 20, 30, 40, 47, 60, 100, 300], 8)
    texts = [(2 * i + j, " ".join(line)) for i, pair in enumerate(pairs) for j, line in enumerate(pair)]
    got = {r.doc_id for r in ld.repeated_lines(docs(texts)).collect()}
    assert got == {2 * i + 1 for i in range(len(pairs))}
    # What a gate of three bits of the SimHash would have let through.
    near = sum((sim_of(" ".join(a)) ^ sim_of(" ".join(b))).bit_count() <= 3 for a, b in pairs)
    assert near < len(pairs) / 3


def test_similar_lines_share_a_run():
    rng = random.Random(8)
    for a, b in pairs_at(rng, list(range(6, 60)), 30):
        found = ld.lines_of(pa.array([" ".join(a), " ".join(b)]))
        runs, owner = ld.runs_in(found)
        shared = set(runs[owner == 0].tolist()) & set(runs[owner == 1].tolist())
        assert shared, (a, b)
        assert ld._matrix(found["words"], ld.bins_of([x.tobytes() for x in ld.bags_of(found)]))[0, 1]


def test_long_lines_of_repeated_words_meet(docs):
    texts = [(1, "a long text " * 400), (2, "a long text " * 390 + "and more"), (3, "another text here " * 400)]
    assert [r.doc_id for r in ld.repeated_lines(docs(texts)).collect()] == [2]


def test_short_lines_keep_one_occurrence(docs):
    texts = [(1, "All rights reserved.\n\nIntro"), (2, "own text of two\nall rights reserved\n\n---"), (3, "intro\n\n---\nShare on"),
             (4, "one two three four"), (5, "one two three four five")]
    got = {r.doc_id: r.text for r in ld.without_repeated_lines(docs(texts)).collect()}
    assert got == {1: texts[0][1], 2: "own text of two\n\n---", 3: "\n---\nShare on", 4: texts[3][1], 5: ""}


def test_pairs_of_a_block_are_those_of_the_matrix():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 2, 9, ld.FEW + 1, 3, ld.STRIP + 40, 1, 3 * ld.STRIP])
    words = rng.integers(4, 40, sizes.sum())
    bins = np.stack([np.bincount(rng.integers(0, 5, n), minlength=ld.BINS) for n in words]).clip(0, 15).astype(np.int8)
    want, at = set(), 0
    for size in sizes:
        i, j = np.nonzero(np.triu(ld._matrix(words[at:at + size], bins[at:at + size])))
        want |= set(zip((at + i).tolist(), (at + j).tolist(), strict=True))
        at += size
    i, j = ld._close(words, bins, sizes)
    got = list(zip(i.tolist(), j.tolist(), strict=True))
    assert set(got) == want and len(got) == len(want) > 100


def test_bags_never_part_similar_lines():
    rng = random.Random(5)
    for n in range(5, 60):
        base = [f"w{rng.randrange(20)}" for _ in range(n)]
        other = edited(rng, base, n // 5)
        if ld.similar(base, other):
            found = ld.lines_of(pa.array([" ".join(base), " ".join(other)]))
            assert ld._matrix(found["words"], ld.bins_of([x.tobytes() for x in ld.bags_of(found)]))[0, 1]


def test_a_first_partner_that_is_not_similar(docs):
    """Lines with their halves exchanged share runs and bags but aren't similar; the similar ones still meet."""
    rng = random.Random(6)
    pairs = []
    for i in range(25):
        line = [f"v{rng.randrange(10**9)}" for _ in range(30)]
        for j, x in enumerate((line, line[15:] + line[:15], [*line[:10], "edited", *line[11:]])):
            pairs.append((3 * i + j, " ".join(x)))
    got = sorted(((r.doc_id, r.text) for r in ld.without_repeated_lines(docs(pairs)).collect()), key=str)
    assert got == brute(pairs)
    assert sorted(i for i, text in got if not text) == list(range(2, 75, 3))


def test_a_pair_is_looked_at_once(docs, monkeypatch):
    """Near copies share most of their runs, but a group takes about as many looks as it has lines."""
    rng = random.Random(9)
    bases = [[f"v{rng.randrange(10**9)}" for _ in range(40)] for _ in range(4)]
    pairs = [(i, " ".join(edited(rng, bases[i % 4], 2))) for i in range(120)]
    looked = []
    real = ld.confirmed

    def counted(pairs, contents):
        pairs = pairs.cache()
        looked.append(pairs.count())
        return real(pairs, contents)

    monkeypatch.setattr(ld, "confirmed", counted)
    assert len(ld.repeated_lines(docs(pairs)).collect()) == 116
    assert looked[0] < 10 * 120 and looked[1] == 0


def block_rows(rng, bases, copies, edits):
    """A block of near copies, as the tasks get it: batches of lines with their words and bags, sorted."""
    lines = sorted({" ".join(edited(rng, base, edits)) for base in bases for _ in range(copies)})
    found = ld.lines_of(pa.array(lines), sims=False)
    n = len(lines)
    names = [str(i).zfill(6).encode() for i in range(n)]
    columns = {"bucket": pa.array([7] * n), "low": pa.array([0] * n, pa.int32()), "high": pa.array([0] * n, pa.int32()),
               "key": pa.array(names, pa.binary()), "words": pa.array(found["words"], pa.int32()),
               "bag": pa.array([x.tobytes() for x in ld.bags_of(found)], pa.binary()),
               "component": pa.array(names, pa.binary()), "content": pa.array([x.encode() for x in lines], pa.binary())}
    return lines, pa.table(columns).to_batches(max_chunksize=50)


def test_blocks_make_no_more_rows_than_they_have_lines():
    """Near copies in groups of their own so far: the rows grow with the lines, not with their pairs."""
    rng = random.Random(12)
    bases = [[f"v{rng.randrange(10**9)}" for _ in range(60)] for _ in range(3)]
    for copies in (20, 80):
        lines, batches = block_rows(rng, bases, copies, 2)
        first = pa.Table.from_batches(ld._likely(iter(batches)))
        assert first.num_rows == len(lines) and first.num_rows - first.column("a").null_count == len(lines) - 3
        assert sum(b.num_rows for b in ld._parted(iter(batches))) == len(lines)
        pairs = [p for b in ld._joining(iter(batches)) for p in zip(*(b.column(n).to_pylist() for n in ("a", "b")), strict=True)]
        assert len(pairs) == len(lines) - 3
        assert all(ld.similar(lines[int(a)].split(), lines[int(b)].split()) for a, b in pairs)


def test_bags_count_repeated_words():
    """Lines of the same words, repeated unlike, don't pass; one word more or less is one bit."""
    lines = ["a " * 300 + "b " * 30, "a " * 30 + "b " * 300, "a " * 301 + "b " * 30]
    found = ld.lines_of(pa.array(lines), sims=False)
    bags = ld.bags_of(found)
    assert [int(np.bitwise_count(bags[0] ^ bags[n]).sum()) for n in (0, 2)] == [0, 1]
    assert ld._matrix(found["words"], ld.bins_of([x.tobytes() for x in bags])).tolist() == [
        [False, False, True], [False, False, False], [True, False, False]]


def test_lines_that_lack_words_take_no_alignment(monkeypatch):
    """Pairs that the bits allow and the words don't end before the edit distance, which is slow for long lines."""
    rng = random.Random(13)
    lines = [" ".join(f"v{rng.randrange(10**9)}" for _ in range(900)) for _ in range(12)]
    found = ld.lines_of(pa.array(lines), sims=False)
    names = pa.array([str(i).zfill(6).encode() for i in range(12)], pa.binary())
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 12), pa.array([0] * 12, pa.int32()), pa.array([0] * 12, pa.int32()), names,
         pa.array(found["words"], pa.int32()), pa.array([x.tobytes() for x in ld.bags_of(found)], pa.binary()), names,
         pa.array([x.encode() for x in lines], pa.binary())],
        ["bucket", "low", "high", "key", "words", "bag", "component", "content"])
    assert sum(b.num_rows for b in ld._parted(iter([batch]))) == 12
    monkeypatch.setattr(ld, "edit_distance", lambda a, b: 1 / 0)
    assert sum(b.num_rows for b in ld._joining(iter([batch]))) == 0
    assert ld._numbered_words([b"a", b"b", b"a"]) == {b"a", b"b", (b"a", 2)}


def test_runs_travel_in_less_than_ten_bytes():
    """Many small batches: equal lines go once, and the first bytes of sorted runs compress."""
    rng = random.Random(14)
    lines = [" ".join(f"v{rng.randrange(10**9)}" for _ in range(30)) for _ in range(4000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(lines[i:i + 200] + lines[:5])], ["text"]) for i in range(0, 4000, 200)]
    out = list(ld._runs(2)(iter(batches)))
    runs = 27 * 4000
    data = [x for b in out for n in ("runs", "marks") for x in b.column(n).to_pylist()]
    assert sum(len(pa.compress(x, codec="lz4", asbytes=True)) for x in data) < 9.9 * runs
    marks = ld._unpacked([x for b in out for x in b.column("marks").to_pylist()], 6)
    assert len(marks) == runs and len(set(marks.tolist())) == 4000


@pytest.mark.parametrize("held", [1, 200, 10**6])
def test_parts_and_batches_hide_no_partner(docs, monkeypatch, held):
    monkeypatch.setattr(ld, "PART_RUNS", 50)
    monkeypatch.setattr(ld, "HELD_RUNS", held)
    got = ld.without_repeated_lines(docs(CASES["fuzzy"])).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(CASES["fuzzy"])
