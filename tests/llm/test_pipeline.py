"""The stages of the pipeline against brute force, each on what its predecessor kept."""

import importlib.util
import os
import random
from pathlib import Path

import pytest

from tests.llm.conftest import words
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_near
from tests.llm.test_packing import verify

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)
import corpus_pipeline as cp  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    item = words(rng, 30, 10**6)
    common = words(rng, 60, 10**6)
    rows, labels = [], []
    for i in range(300):
        text = "\n".join(words(rng, rng.randrange(8, 40), 10**6) for _ in range(rng.randrange(1, 6)))
        bad = i % 5 == 0
        if bad:
            text = text.upper().replace(" ", "!! ")
        elif i % 7 == 0:
            text += "\n" + common
        elif i % 11 == 0:
            text += "\n" + item
        elif i % 13 == 0 and i > 13:
            text = rows[-1][1]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 2:
            labels.append((i, int(not bad), 0))
        elif bad:
            labels.append((i, 0, 0))
    rows += [(900, None, "en", "s1", 0), (901, "", None, None, None), (None, words(rng, 50, 10**6), "en", "s0", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), item


def test_every_stage(spark, folder):
    sf_dir, item = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]
    before = [tuple(r) for r in docs.collect()]
    for name, step in cp.STAGES:
        out = step(spark, docs, sf_dir)
        path = f"{sf_dir}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        rows = [tuple(r) for r in after.collect()]
        if name != "packing":
            assert after.columns == docs.columns
        pairs = [(r[0], r[1]) for r in before]
        if name == "quality_classifier":
            assert not any("!!" in (r[1] or "") for r in rows)
            assert {r[0] for r in rows} >= {r[0] for r in before if r[0] is not None and r[0] < 300 and "!!" not in r[1]}
            assert set(rows) <= set(before)
        elif name == "line_dedup":
            want = [(i, t) for i, t in brute_lines(pairs) if (t or "").strip() or not (dict(pairs)[i] or "").strip()]
            assert sorted(((r[0], r[1]) for r in rows), key=str) == sorted(want, key=str)
            assert all(r[4] == len(r[1] or "") for r in rows if r[0] is not None and r[0] < 900)
        elif name == "near_dedup":
            kept = [r[0] for r in brute_near(pairs, 5, 80, 100) if r[3]]
            assert sorted((r[0] for r in rows), key=str) == sorted(kept, key=str)
        elif name == "decontamination":
            assert set(rows) == {r for r in before if item not in (r[1] or "")} and len(rows) < len(before)
        else:
            from tokenizers import Tokenizer

            import public_tokenizers
            verify(pairs, after.collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        docs, before = after, rows


def test_run_is_the_stages_and_is_repeatable(spark, folder):
    sf_dir, _ = folder
    first = sorted(map(tuple, cp.run(spark, sf_dir).collect()), key=str)
    assert first == sorted(map(tuple, cp.run(spark, sf_dir).collect()), key=str) and first


def test_empty_documents(spark, folder, tmp_path):
    sf_dir, _ = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, step in cp.STAGES:
        out = step(spark, docs, sf_dir)
        assert out.count() == 0


def test_import_errors_show(tmp_path):
    source = Path(cp.__file__).read_text()
    assert "except" not in source


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_registered(spark):
    from __spark_entry__ import oracle_sql, queries
    from tidemill.llm.queries import ORACLES, QUERIES

    assert {"pipeline", *QUERIES} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_near_dedup", "op10_chat", "op12_fill_in_middle", "op13_source_audit"])
def test_equals_sql(spark, name):
    import duckdb

    from compare import canonical
    from tidemill.llm.queries import ORACLES, QUERIES

    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    want = db.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, want.fetchall())
