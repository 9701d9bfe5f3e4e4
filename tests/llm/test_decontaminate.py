import random

import pyarrow as pa
import pytest

from tests.llm.conftest import words
from tidemill.llm import decontaminate as dc


def kinds(text):
    found, _ = dc.tokens(pa.array([text]))
    return "".join("wnNu"[k] for k in found.kind)


def test_slots():
    assert kinds("The train leaves at 5.30 and runs 1,200 km with Anna Maria Smith.") == "wwwwnwwnuwN"
    assert kinds("Anna has 5 apples. Bob has 3 kg") == "wwnwwwnu"
    assert kinds("ALL CAPS AND km alone") == "wwwww"
    assert kinds("für Élodie und 3.") == "wNwn"
    assert kinds("") == "" and kinds("5") == "n"
    texts = pa.array(["a 5", "km b", None, "Anna"])  # a text's edge ends everything
    assert "".join("wnNu"[k] for k in dc.tokens(texts)[0].kind) == "wnwww"


ITEM = ("A train from Boston leaves at 9 in the morning and travels 120 miles before Anna "
        "boards, then 120 miles more until it stops for 15 minutes.")
SAME = ITEM.replace("Boston", "Denver").replace("Anna", "Maria Lopez").replace("120", "75").replace("15", "40")
BROKEN = ITEM.replace("travels 120", "travels 75")


def leaks(docs, spark, pairs, items):
    frame = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as coverage")
    return sorted((r.doc_id, r.item_id, r.same_slots) for r in dc.leaks(docs(pairs), frame).collect())


def test_copies_and_reparameterised_items(docs, spark):
    rng = random.Random(1)
    noise = lambda: words(rng, 60)
    pairs = [(1, f"{noise()} {ITEM} {noise()}"), (2, f"{noise()} {SAME} {noise()}"), (3, noise()), (4, ITEM.upper()),
             (5, ITEM.replace(" ", "\n--  ")), (6, None), (7, ""), (8, "tiny item of four"), (9, " ".join(ITEM.split()[:9])),
             (10, f"{noise() * 300} {ITEM}"), (8, "tiny item of four"), (11, BROKEN)]
    items = [(100, ITEM), (101, "tiny item of four"), (102, None), (103, ""), (104, words(rng, 40)), (100, ITEM)]
    got = set(leaks(docs, spark, pairs, items))
    assert {(i, k) for i, k, _ in got} >= {(1, 100), (2, 100), (4, 100), (5, 100), (10, 100), (8, 101)}
    assert {i for i, _, _ in got} <= {1, 2, 4, 5, 8, 10, 11}
    assert (1, 100, True) in got and (2, 100, False) in got
    kept = dc.without_leaks(docs(pairs), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs([]).columns
    assert {r.doc_id for r in kept.collect()} >= {3, 6, 7, 9} and not {r.doc_id for r in kept.collect()} & {1, 2, 4, 5, 8, 10}


def test_inconsistent_slots_break_a_run():
    item = "x1 x2 x3 x4 x5 x6 x7 120 x8 x9 y1 y2 y3 y4 y5 120 y6 y7 y8"
    found = dc.Benchmark([1], [item])

    def run(text):
        return max((f[2] for f in found.find(pa.array([text]))), default=0)

    assert run(item) == 19 and run(item.replace("120", "7")) == 19
    assert run(item.replace("x7 120", "x7 7")) == 15  # up to the second 120
    assert found.find(pa.array(["", None, "x1 x2"])) == []


@pytest.mark.parametrize("chars", [10**9, 400])
def test_brute_force_on_plain_words(docs, spark, monkeypatch, chars):
    monkeypatch.setattr(dc, "BLOCK_CHARS", chars)
    rng = random.Random(2)
    items = [(i, words(rng, rng.randrange(3, 40), 10**6)) for i in range(25)]
    pairs = []
    for i in range(60):
        text = words(rng, rng.randrange(5, 80), 10**6).split()
        if i % 3 == 0:
            own = rng.choice(items)[1].split()
            begin = rng.randrange(len(own))
            text[3:3] = own[begin:begin + rng.randrange(1, 40)]
        pairs.append((i, " ".join(text)))
    want = set()
    for i, text in pairs:
        for k, item in items:
            a, b = text.split(), item.split()
            need = min(dc.RUN, len(b))
            runs = {" ".join(b[j:j + need]) for j in range(len(b) - need + 1)}
            if any(" ".join(a[j:j + need]) in runs for j in range(len(a))):
                want.add((i, k, True))
    assert set(leaks(docs, spark, pairs, items)) == want and want


def test_empty_sides(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, spark, [(1, ITEM)], []) == []
    assert dc.leaks(docs([]), none).count() == 0
    assert dc.without_leaks(docs([(1, ITEM)]), none).count() == 1


def found_in(item, text):
    return bool(dc.Benchmark([1], [item]).find(pa.array([text])))


def test_names_that_begin_sentences_are_slots():
    item = "Ali has 12 marbles. Ali gives 3 to Ben. How many marbles does Ali have left now?"
    assert found_in(item, item.replace("Ali", "Omar").replace("12", "20"))
    assert not found_in(item, item.replace("marbles", "coins").replace("gives", "sells"))


def test_items_dense_in_numbers():
    item = "add 12 kg 5 kg and 7 kg 9 kg then 3 kg 4 kg less 2 kg 8 kg total"
    assert found_in(item, item.replace("12", "40").replace("9", "61"))
    assert not found_in(item, " ".join(str(n) for n in range(100, 140)))


def test_a_run_goes_on_behind_the_earlier_slot():
    item = "x1 x2 x3 5 x4 x5 x6 x7 x8 x9 y1 5 y2 y3 y4 y5 y6 y7 y8 y9"
    assert found_in(item, item.replace("x3 5", "x3 6"))
