import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from tidemill.llm import near_dedup as nd
from tidemill.llm.components import components


def shingles(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not low:
        return frozenset()
    return frozenset(tuple(low[i:i + size]) for i in range(max(1, len(low) - size + 1)))


def brute(pairs, size, num, den):
    sets = [shingles(t, size) for _, t in pairs]
    group = list(range(len(pairs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if sets[i] and root(j) == root(i) and pairs[j][0] is not None]
        least = min(ids) if ids else doc
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def near_copies(seed, groups=6, copies=9):
    rng = random.Random(seed)
    pairs, n = [], 0
    for _ in range(groups):
        base = words(rng, rng.randrange(5, 160)).split()
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 7)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            pairs.append((n, " ".join(text)))
            n += 1
    rng.shuffle(pairs)
    return pairs


CASES = {
    "empty": [],
    "edges": [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a\x0bb c d e"),
              (8, "a b c d e"), (8, "a b c d e"), (None, "A b c d e"), (None, "only this one here now"), (9, "é É")],
    "copies": [(i, "the same words again and again and again") for i in range(40)],
    "near": near_copies(1),
    "long": [(1, words(random.Random(4), 30_000)), (2, words(random.Random(4), 30_000) + " more"), (3, "short")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("size,num", [(3, 85), (5, 80)])
def test_equals_brute_force(docs, name, size, num):
    got = nd.near_duplicates(docs(CASES[name]), shingle=size, num=num).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute(CASES[name], size, num, 100)


def test_large_buckets_are_dealt_out_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)
    pairs = near_copies(2, groups=2, copies=40)
    got = nd.near_duplicates(docs(pairs), shingle=3, num=85).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute(pairs, 3, 85, 100)


def test_keep_one(docs):
    kept = nd.keep_one(docs(CASES["edges"] + [(20, None), (21, "")]))
    assert kept.columns == docs([]).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # Rows 8 repeat one document; texts without words stay.
    assert ids == sorted([1, 2, 3, 4, 6, 7, 9, 20, 21, None], key=str)


def test_sketches_are_full_and_estimate():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [a[:600], a[:1], a[150:750]]
    first = np.cumsum([0] + [len(s) for s in sets])
    sketch = nd.sketches(np.concatenate(sets), first, 400)
    assert not (sketch == np.uint64(2**64 - 1)).any()
    assert abs((sketch[0] == sketch[2]).mean() - 450 / 750) < 0.1
    alone = nd.sketches(sets[2], np.array([0, 600]), 400)
    assert (alone[0] == sketch[2]).all()  # whatever else is in the batch


def test_word_hashes_do_not_depend_on_the_batch():
    texts = pa.array(["Some Words here", None, "", "here some  words\x1c", "übung"])
    whole, first = nd.word_hashes(texts)
    for i in range(len(texts)):
        alone, _ = nd.word_hashes(texts.slice(i, 1))
        assert (whole[first[i]:first[i + 1]] == alone).all()
    assert whole[0] == whole[4] and np.diff(first).tolist() == [3, 0, 0, 3, 1]


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (100, 100), (None, 5)]
    links += [(1000, 1000 + i) for i in range(1, 80)]
    rng.shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, **{1000 + i: 1000 for i in range(80)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
