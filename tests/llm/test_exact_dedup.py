import hashlib
import random

import numpy as np
import pytest

from tidemill.llm import exact_dedup as xd


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in pairs:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("pairs", [
    [],
    [(1, None), (2, ""), (3, " "), (4, "A"), (5, "a"), (6, "É"), (7, "é")],
    [(1, "same"), (1, "same"), (None, "SAME"), (None, "alone"), (2, "x" * 300_000), (3, "X" * 300_000)],
    [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(300)],
])
def test_equals_brute_force(docs, pairs):
    got = sorted(map(tuple, xd.exact_duplicates(docs(pairs)).collect()), key=str)
    assert got == brute(pairs)


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2**63, 50, dtype=np.uint64) for _ in range(3)]
    parts += [parts[0][:20], np.zeros(0, np.uint64), np.repeat(parts[1][:1], 9)]
    values, counts = xd.merge_filters([xd.build_filter(p) for p in parts])
    want_values, want_counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (values == want_values).all() and (counts == want_counts).all()
    assert len(xd.merge_filters([])[0]) == 0


@pytest.mark.parametrize("bits", [0, 4, 13])
def test_slices_round_trip(bits):
    values = np.sort(np.random.default_rng(2).integers(0, 2**64, 400, dtype=np.uint64))
    high = values >> np.uint64(64 - bits) if bits else np.zeros(400, np.uint64)
    for quotient in np.unique(high):
        own = values[high == quotient]
        assert (xd.unpack_slice(int(quotient), bits, xd.pack_slice(own, bits)[0]) == own).all()


def test_repeated_prints(spark):
    rng = random.Random(3)
    prints = [rng.randrange(-2**63, 2**63) for _ in range(500)]
    data = prints + prints[:40] + prints[:1] * 200
    df = spark.createDataFrame([(p,) for p in data], "print long").repartition(6)
    got = dict(map(tuple, xd.repeated_prints(df, len(data)).collect()))
    assert got == {p: data.count(p) for p in prints[:40]}


def test_a_part_of_many_short_texts_merges_in_linear_time():
    import time

    import pyarrow as pa

    def took(rows):
        prints = np.random.default_rng(1).integers(0, 2**62, rows)
        batches = [pa.record_batch([pa.array(prints[i:i + 512])], ["print"]) for i in range(0, rows, 512)]
        begun = time.perf_counter()
        out = list(xd._slices(4)(iter(batches)))
        assert sum(len(c.as_py()) // 8 for b in out for c in b.column("counts")) == len(np.unique(prints))
        return time.perf_counter() - begun

    took(5_000)
    assert took(400_000) < 20 * took(50_000)  # eight times the rows
