import pytest
from pyspark.sql import functions as F

from tidemill.sources import tables


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "id long, v string")


def test_snapshots_and_time_travel(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    assert not tables.table_exists(spark, path)
    assert tables.write_snapshot(frame(spark, [(1, "a")]), path) == 0
    assert tables.write_snapshot(frame(spark, [(1, "b"), (2, "c")]), path) == 1
    assert rows(tables.read_table(spark, path, version=0)) == [(1, "a")]
    assert rows(tables.read_table(spark, path), "id") == [(1, "b"), (2, "c")]
    history = tables.table_history(spark, path).select("version", "operation", "rows_written")
    assert rows(history, "version") == [(0, "overwrite", 1), (1, "overwrite", 2)]
    assert tables.rows_written(spark, path) == 2


def test_partitioned_snapshot(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    tables.write_snapshot(frame(spark, [(1, "a"), (2, "b")]), path, partition_by=["v"])
    assert rows(tables.read_table(spark, path).select("id", "v"), "id") == [(1, "a"), (2, "b")]


def test_missing_table(spark, tmp_path):
    path = str(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    schema = frame(spark, [(1, "a")]).schema
    empty = tables.read_table(spark, path, schema_if_missing=schema)
    assert empty.schema == schema and empty.count() == 0
    assert tables.table_schema(spark, path) is None
    assert tables.table_history(spark, path).count() == 0


def test_schema_drift_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_snapshot(frame(spark, [(1, "a")]), path)
    wider = frame(spark, [(1, "a")]).withColumn("x", F.lit(1))
    with pytest.raises(ValueError, match="schema"):
        tables.write_snapshot(wider, path)
    tables.write_snapshot(wider, path, allow_evolution=True)
    assert tables.table_schema(spark, path).fieldNames() == ["id", "v", "x"]


def test_upsert_replaces_inserts_and_repeats(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    assert tables.upsert(spark, path, frame(spark, []), ["id"]) is None
    tables.upsert(spark, path, frame(spark, [(1, "a"), (2, "b")]), ["id"])
    change = frame(spark, [(2, "B"), (3, "c")])
    tables.upsert(spark, path, change, ["id"])
    want = [(1, "a"), (2, "B"), (3, "c")]
    assert rows(tables.read_table(spark, path), "id") == want
    tables.upsert(spark, path, change, ["id"])
    assert rows(tables.read_table(spark, path), "id") == want
    assert rows(tables.read_table(spark, path, version=0), "id") == [(1, "a"), (2, "b")]
    assert tables.upsert(spark, path, frame(spark, []), ["id"]) == 2


def test_upsert_after_full_refresh(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    tables.write_snapshot(frame(spark, [(i, "a") for i in range(100)]), path)
    tables.upsert(spark, path, frame(spark, [(5, "b"), (200, "c")]), ["id"])
    got = dict(rows(tables.read_table(spark, path)))
    assert len(got) == 101 and got[5] == "b" and got[200] == "c" and got[6] == "a"


def files_of(folder):
    return {f: f.stat().st_mtime_ns for f in folder.glob("data/*/_slot=*/part-*")}


def test_upsert_rewrites_the_slots_of_its_rows_only(spark, tmp_path, rows):
    path, slot = str(tmp_path / "t"), tables.hashed(["id"], 16)
    tables.upsert(spark, path, spark.range(20_000).selectExpr("id", "'a' as v"), ["id"], slot)
    before = files_of(tmp_path / "t")
    assert len({f.parent.name for f in before}) == 16
    tables.upsert(spark, path, spark.range(2).selectExpr("id * 30000 as id", "'b' as v"), ["id"])  # laid out by then
    after = files_of(tmp_path / "t")
    touched = {f.parent.name for f in set(before) ^ set(after)}
    assert len(touched) <= 2 and all(after[f] == before[f] for f in before if f.parent.name not in touched)
    assert tables.rows_written(spark, path) == 2
    assert rows(tables.read_table(spark, path).groupBy("v").count(), "v") == [("a", 19_999), ("b", 2)]
    plan = tables._rows(spark, path, tables._record(spark, path)).filter("_slot in ('1', '2')")
    assert "PartitionFilters: [_slot" in plan._jdf.queryExecution().executedPlan().toString()


def test_many_upserts_by_slot(spark, tmp_path, rows):
    path, slot = str(tmp_path / "t"), tables.hashed(["id"], 4)
    want = {}
    for n in range(6):
        batch = [(i, f"v{n}") for i in range(n, n + 5)]
        tables.upsert(spark, path, frame(spark, batch), ["id"], slot)
        want.update(batch)
    assert dict(rows(tables.read_table(spark, path))) == want
    assert tables.read_table(spark, path).columns == ["id", "v"]
    assert rows(tables.table_history(spark, path).select("version", "operation", "rows_written"), "version") == [
        (n, "upsert", 5) for n in range(6)]
    with pytest.raises(ValueError, match="overwritten"):
        tables.read_table(spark, path, version=2)
    with pytest.raises(ValueError, match="slots"):
        tables.upsert(spark, path, frame(spark, [(1, "x")]), ["id"], tables.hashed(["id"], 8))


def test_a_snapshot_is_laid_out_in_slots_by_an_upsert(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    tables.write_snapshot(frame(spark, [(i, "a") for i in range(50)]), path)
    tables.upsert(spark, path, frame(spark, [(3, "b"), (99, "c")]), ["id"], tables.hashed(["id"], 4))
    got = dict(rows(tables.read_table(spark, path)))
    assert len(got) == 51 and (got[3], got[99], got[4]) == ("b", "c", "a")
    assert tables.has_slots(spark, path) and tables.read_table(spark, path, version=0).count() == 50


def test_the_latest_row_of_a_key_stays_in_any_order_of_loads(spark, tmp_path, rows):
    loads = [[(1, "a"), (2, "c"), (None, "x")], [(1, "b"), (2, "b")], [(None, "y"), (3, "a")]]
    slot, want = tables.hashed(["id"], 4), None
    for n, order in enumerate(((0, 1, 2), (2, 0, 1, 0), (1, 1, 2, 0))):
        path = str(tmp_path / f"t{n}")
        for i in order:
            tables.merge_latest(spark, path, frame(spark, loads[i]), ["id"], [F.desc("v")], slot)
        got = sorted(rows(tables.read_table(spark, path)), key=str)
        want = want or got
        assert got == want == [(1, "b"), (2, "c"), (3, "a"), (None, "y")]
    assert tables.rows_written(spark, path) == 1  # of the last load only (2, "c") was new


def test_counts_come_from_the_writing_job(spark, tmp_path):
    df = frame(spark, [(1, "a"), (2, None), (3, None)])
    path = str(tmp_path / "x")
    counts = tables.write_counted(df, lambda w: w.parquet(path), empty=F.count_if(F.col("v").isNull()))
    assert counts == {"rows": 3, "empty": 2}
    none = tables.write_counted(df.filter("id > 5"), lambda w: w.parquet(str(tmp_path / "y")))
    assert none == {"rows": 0}


RETRIED = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from tidemill.sources import tables
spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")
         .config("spark.sql.warehouse.dir", sys.argv[1] + "/w").getOrCreate())

def once(batches):
    for n, batch in enumerate(batches):
        yield batch
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")

df = spark.range(0, 1000, 1, 4).mapInArrow(once, "id long")
tables.write_snapshot(df, sys.argv[1] + "/t")
tables.upsert(spark, sys.argv[1] + "/t", df, ["id"], tables.hashed(["id"], 4))
print("ROWS", tables.table_history(spark, sys.argv[1] + "/t").orderBy("version").select("rows_written").collect())
"""


def test_retried_tasks_count_once(tmp_path):
    import subprocess
    import sys
    from pathlib import Path
    root = Path(tables.__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path)], capture_output=True, text=True,
                         cwd=root, timeout=240)
    assert "lost" in out.stderr
    assert "ROWS [Row(rows_written=1000), Row(rows_written=1000)]" in out.stdout, out.stderr[-2000:]


def test_a_refresh_scans_its_input_once(spark, tmp_path):
    """Rows are counted by the job that writes them: the source is read by one job, once."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    tables.write_snapshot(spark.range(0, 500, 1, 3).mapInArrow(seen, "id long"), str(tmp_path / "t"))
    assert read.value == 500


def test_slots_of_groups_that_are_gone_are_emptied(spark, tmp_path, rows):
    path, slot = str(tmp_path / "t"), tables.hashed(["g"], 8)
    schema = "g string, n int"
    put = lambda data, gone=(): tables.replace_groups(
        spark, path, spark.createDataFrame(data, schema), ["g"], spark.createDataFrame(list(gone), schema), slot)
    put([(g, n) for g in "abcdefgh" for n in (1, 2)])
    put([("a", 9)], [(g, None) for g in "bcdefgh"])
    assert rows(tables.read_table(spark, path)) == [("a", 9)]
    put([], [("a", None)])
    assert tables.read_table(spark, path).count() == 0
    put([("b", 5)])
    assert rows(tables.read_table(spark, path)) == [("b", 5)]


def test_groups_are_replaced_whole(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    schema = "g string, n int"
    put = lambda data, gone=(): tables.replace_groups(
        spark, path, spark.createDataFrame(data, schema), ["g"], spark.createDataFrame(list(gone), schema))
    put([("a", 1), ("a", 2), ("b", 1), ("c", 1)])
    put([("a", 9)], [("b", None)])
    assert rows(tables.read_table(spark, path), "g", "n") == [("a", 9), ("c", 1)]
    put([("b", 5), ("c", 2), ("c", 3), ("d", 1), ("e", 1)])
    assert rows(tables.read_table(spark, path), "g", "n") == [
        ("a", 9), ("b", 5), ("c", 2), ("c", 3), ("d", 1), ("e", 1)]


def test_a_dead_writer_blocks_nothing(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    (tmp_path / "t/data/abandoned/_temporary").mkdir(parents=True)
    assert not tables.table_exists(spark, path)
    assert tables.write_snapshot(frame(spark, [(1, "a")]), path) == 0
    for file in (tmp_path / "t/current").glob("*"):  # died while it replaced the pointer
        file.unlink()
    assert rows(tables.read_table(spark, path)) == [(1, "a")]
    assert tables.write_snapshot(frame(spark, [(2, "b")]), path) == 1
    assert rows(tables.read_table(spark, path)) == [(2, "b")]


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_snapshot(frame(spark, [(1, "a")]), path)
    begun = tables._record(spark, path)
    tables.write_snapshot(frame(spark, [(2, "b")]), path)
    with pytest.raises(ValueError, match="another writer"):
        tables._publish(spark, path, begun, "overwrite", 1, "data/x", None, frame(spark, [(1, "a")]).schema)


def test_upsert_guards(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="repeats"):
        tables.upsert(spark, path, frame(spark, [(1, "a"), (1, "b")]), ["id"])
    tables.upsert(spark, path, frame(spark, [(1, "a"), (None, "n")]), ["id"])
    with pytest.raises(ValueError):
        tables.upsert(spark, path, frame(spark, [(1, "a")]).withColumn("x", F.lit(1)), ["id"])
    # A null key matches nothing, so it is inserted again.
    tables.upsert(spark, path, frame(spark, [(None, "m")]), ["id"])
    assert sorted(v for _, v in rows(tables.read_table(spark, path))) == ["a", "m", "n"]


def test_upsert_composite_key(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    schema = "a int, b string, n long"
    tables.upsert(spark, path, spark.createDataFrame([(1, "x", 1), (1, "y", 2)], schema), ["a", "b"])
    tables.upsert(spark, path, spark.createDataFrame([(1, "y", 9)], schema), ["a", "b"])
    assert rows(tables.read_table(spark, path), "b") == [(1, "x", 1), (1, "y", 9)]


def test_views(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_snapshot(frame(spark, [(1, "a")]), path)
    tables.register_views(spark, {"bronze_t": path})
    assert spark.sql("select v from bronze_t").first()[0] == "a"


def test_newest_version_is_found_in_a_long_history(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    for n in range(11):
        assert tables.write_snapshot(frame(spark, [(n, "v")]), path) == n
        assert rows(tables.read_table(spark, path)) == [(n, "v")]
    assert rows(tables.read_table(spark, path, version=6)) == [(6, "v")]
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path, version=12)
