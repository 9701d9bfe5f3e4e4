import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from tidemill.llm import quality as q


def test_statistics_of_odd_texts():
    texts = pa.array(["", None, " ", "\n\n", "a", "A b\nA b\n", "é" * 10, "x " * 50_000])
    rows = q.statistics(texts)
    assert rows.shape == (8, len(q.FEATURES)) and np.isfinite(rows).all()
    assert (rows[0] == 0).all() and (rows[1] == 0).all()
    for i in range(8):  # whatever else is in the batch
        assert (q.statistics(texts.slice(i, 1))[0] == rows[i]).all()
    row = dict(zip(q.FEATURES, rows[5], strict=True))
    assert row["repeated_lines"] == 0.5 and row["distinct"] == 0.5 and row["upper"] == 0.25


def test_trees_learn_and_flat_traversal_is_the_tree():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(3000, 5)).astype(np.float32)
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 2] > -0.1)).astype(float)
    model = q.fit(rows[:2000], labels[:2000])
    scores = model.score(rows[2000:])
    assert ((scores > 0.5) == labels[2000:]).mean() > 0.97
    inner = model.feature.shape[1]
    for row, score in zip(rows[2000:2050], scores, strict=False):
        total = model.base
        for feature, above, leaf in zip(model.feature, model.above, model.leaf, strict=True):
            at = 0
            while at < inner:
                at = 2 * at + 2 if row[feature[at]] > above[at] else 2 * at + 1
            total += leaf[at - inner]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_one_label_or_none_gives_a_constant():
    assert q.fit(np.zeros((0, 3), np.float32), np.zeros(0)).score(np.zeros((2, 3), np.float32)).tolist() == [0.5, 0.5]
    only = q.fit(np.ones((8, 3), np.float32), np.ones(8)).score(np.zeros((2, 3), np.float32))
    assert only[0] == only[1] == pytest.approx(0.9)


def corpus(n=900):
    rng = random.Random(7)
    pairs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = words(rng, rng.randrange(3, 120))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), "spam " * 60])
        pairs.append((i, text))
        if i % 3:
            labels.append((i, int(good), 0))
    return pairs, labels, {i: int(g) for i, g, _ in labels}


def test_held_out_accuracy_and_contract(spark, docs):
    pairs, labels, truth = corpus()
    df = docs(pairs + [(5000, ""), (5001, None), (None, "no id at all")])
    labelled = spark.createDataFrame(labels + [(7, 1, 0), (None, 1, 1), (11, None, 0)],
                                     "doc_id long, quality int, toxic int")
    model = q.train(df, labelled)
    got = {r.doc_id: r.score for r in q.quality_scores(df, model).collect()}
    assert len(got) == len(pairs) + 3 and all(0 <= s <= 1 for s in got.values())
    import zlib
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100
    assert np.mean([(got[i] >= 0.7) == truth[i] for i in held]) > 0.95
    kept = q.keep_good(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.7}
    # Labels of held-out rows change nothing.
    other = labelled.withColumn("quality", q.F.when(q.held_out(), 1 - q.F.col("quality")).otherwise(q.F.col("quality")))
    again = q.train(df, other)
    assert (again.leaf == model.leaf).all() and (again.above == model.above).all()


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = q.train(docs([]), none)
    assert q.quality_scores(docs([]), model).count() == 0
    assert q.keep_good(docs([(1, "a")]), model).count() == 0  # nothing learned: 0.5 is under the threshold


def test_repeated_rows_count_once(spark, docs):
    pairs, labels, _ = corpus(400)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = q.train(docs(pairs), labelled)
    hot = next(i for i, g, _ in labels if g == 0)
    many = docs(pairs * 10 + [p for p in pairs if p[0] == hot] * 1000)
    again = q.train(many, labelled.unionByName(labelled))
    assert (again.leaf == plain.leaf).all() and (again.above == plain.above).all() and again.base == plain.base
    bounded = q.train(many, labelled, sample=60)
    scores = {r.doc_id: r.score for r in q.quality_scores(docs(pairs), bounded).collect()}
    assert min(scores.values()) < 0.3 and max(scores.values()) > 0.8
    both = labelled.unionByName(spark.createDataFrame([(i, 0, 0) for i, *_ in labels], labelled.schema))
    assert q.train(docs(pairs), both).base < plain.base  # of two labels the lower one counts
