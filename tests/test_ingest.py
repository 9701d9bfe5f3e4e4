import json

import pytest
from pyspark.sql import functions as F

from tidemill.plans import revenue
from tidemill.plans.runlog import RunLog
from tidemill.sources import corpus, raw, tables

ORDERS = raw.SourceSpec("orders", "json", "raw/orders", "bronze/orders", "order_id", "updated_at")
CUSTOMERS = raw.SourceSpec("customers", "csv", "raw/customers", "bronze/customers", "customer_id",
                           "updated_at", options={"header": "true"})


def order(order_id, updated, amount=10.0, status="completed", customer=1):
    return {"order_id": order_id, "customer_id": customer, "order_amount": amount,
            "order_status": status, "created_at": "2024-05-01T10:00:00+00:00",
            "updated_at": f"2024-05-01T{updated}:00+00:00"}


@pytest.fixture
def lake(spark, tmp_path):
    (tmp_path / "raw/orders").mkdir(parents=True)
    (tmp_path / "raw/customers").mkdir()
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))
    return tmp_path, str(tmp_path), log


def drop(folder, name, records):
    (folder / "raw/orders" / name).write_text("\n".join(json.dumps(r) for r in records))


def test_config(tmp_path):
    specs = raw.load_specs("conf/sources.yaml")
    assert [(s.name, s.format, s.primary_key) for s in specs] == [
        ("orders", "json", "order_id"), ("customers", "csv", "customer_id")]
    assert specs[1].options == {"header": "true"}
    with pytest.raises(ValueError, match="Unsupported format"):
        raw.SourceSpec("x", "xml", "a", "b")


def test_lakehouse_end_to_end(spark, lake, rows):
    folder, root, log = lake
    drop(folder, "a.json", [order("o1", "10:00", 5.0), order("o2", "09:00", 7.5, customer=9)])
    drop(folder, "b.json", [order("o1", "11:00", 6.0), order("o3", "09:00", status="cancelled")])
    (folder / "raw/orders/skip.txt").write_text("{not json")
    (folder / "raw/customers/c1.csv").write_text(
        "customer_id,email,signup_date,region,updated_at\n"
        "1,a@x,2024-01-01,us-east,2024-01-02T00:00:00+00:00\n"
        "1,a@x,2024-01-01,eu-west,2024-01-03T00:00:00+00:00\n")
    bronze = raw.ingest_all(spark, [ORDERS, CUSTOMERS], log, root)
    assert bronze["orders"].count() == 4
    assert bronze["orders"].select("_ingested_at").distinct().count() == 1
    silver = revenue.stg_orders(bronze["orders"])
    assert rows(silver.select("order_id", F.col("order_amount").cast("string")), "order_id") == [
        ("o1", "6.00"), ("o2", "7.50"), ("o3", "10.00")]
    gold = revenue.daily_revenue(silver, revenue.stg_customers(bronze["customers"]))
    got = rows(gold.select("region", "order_count", F.col("total_revenue").cast("string")), "region")
    assert got == [(None, 1, "7.50"), ("eu-west", 1, "6.00")]
    runs = rows(log.runs().select("job_name", "job_type", "status", "rows_written"), "job_name")
    assert runs == [("autoloader_customers", "batch_ingestion", "success", 2),
                    ("autoloader_orders", "batch_ingestion", "success", 4)]
    # A second load is a new version; the first stays readable.
    drop(folder, "c.json", [order("o4", "12:00")])
    raw.ingest_one(spark, [ORDERS, CUSTOMERS], "orders", log, root)
    path = f"{root}/bronze/orders"
    assert tables.read_table(spark, path).count() == 5
    assert tables.read_table(spark, path, version=0).count() == 4


def test_missing_input_is_a_failed_run(spark, lake, rows):
    folder, root, log = lake
    with pytest.raises(FileNotFoundError, match="No json files found under"):
        raw.ingest(spark, ORDERS, log, root)
    [(status, error)] = rows(log.runs().select("status", "error_message"))
    assert status == "failed" and error == f"No json files found under {root}/raw/orders"
    with pytest.raises(FileNotFoundError):
        raw.read_raw(spark, raw.SourceSpec("x", "csv", "nowhere", "b"), root)


def test_malformed_json_fails(spark, lake):
    folder, root, log = lake
    (folder / "raw/orders/a.json").write_text('{"order_id": "o1"}\n{broken\n')
    with pytest.raises(Exception):
        raw.ingest(spark, ORDERS, log, root)


def test_csv_files_match_by_name(spark, lake, rows):
    folder, root, _ = lake
    (folder / "raw/customers/a.csv").write_text("customer_id,region\n1,us\n2,eu\n")
    (folder / "raw/customers/b.csv").write_text("region,customer_id,email\nap,3,z@x\n")
    df = raw.read_raw(spark, CUSTOMERS, root)
    assert rows(df.select("customer_id", "region", "email"), "customer_id") == [
        (1, "us", None), (2, "eu", None), (3, "ap", "z@x")]
    declared = raw.SourceSpec("customers", "csv", "raw/customers", "b",
                              schema="customer_id int, region string, signup date")
    assert rows(raw.read_raw(spark, declared, root).select("customer_id", "region", "signup"), "customer_id") == [
        (1, "us", None), (2, "eu", None), (3, "ap", None)]
    (folder / "raw/customers/c.csv").write_text("customer_id\nx\n")
    with pytest.raises(Exception):
        raw.read_raw(spark, declared, root).collect()


def test_json_files_match_by_name(spark, lake, rows):
    folder, root, _ = lake
    (folder / "raw/orders/a.json").write_text('{"a": 1}\n')
    (folder / "raw/orders/b.json").write_text('{"b": "x"}\n')
    df = raw.read_raw(spark, ORDERS, root)
    assert rows(df.select("a", "b"), "a") == [(None, "x"), (1, None)]


def test_incremental_merge(spark, lake, rows):
    folder, root, log = lake
    drop(folder, "a.json", [order("o1", "10:00", 5.0), order("o2", "10:00", 1.0)])
    raw.ingest(spark, ORDERS, log, root, incremental=True)
    drop(folder, "b.json", [order("o1", "11:00", 6.0), order("o2", "09:00", 9.0),
                            order("o3", "12:00", 3.0)])
    df = raw.ingest(spark, ORDERS, log, root, incremental=True)
    assert rows(df.select("order_id", "order_amount"), "order_id") == [
        ("o1", 6.0), ("o2", 1.0), ("o3", 3.0)]


def test_corpus(spark, tmp_path, rows):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/a.md").write_bytes(b"one\n\ntwo\xff" + "\ufffd".encode())
    (tmp_path / "docs/sub/b.md").write_text("three")
    (tmp_path / "docs/c.txt").write_text("no")
    got = rows(corpus.load_corpus(spark, str(tmp_path / "docs"), "*.md"), "text")
    assert [t for _, t in got] == ["one\n\ntwo\ufffd", "three"]
    assert got[0][0].endswith("/docs/a.md")


def test_manifest_lineage(spark, tmp_path, rows):
    from tidemill.plans import lineage
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({
        "metadata": {"x": 1},
        "nodes": {
            "model.p.stg_orders": {"schema": "silver", "name": "stg_orders",
                                   "depends_on": {"nodes": ["source.p.bronze.orders"]}},
            "model.p.daily": {"schema": "gold", "name": "daily", "depends_on": {
                "nodes": ["model.p.stg_orders", "source.p.bronze.gone", "macro.p.m"]}}},
        "sources": {"source.p.bronze.orders": {"name": "orders"},
                    "source.p.bronze.gone": {"name": "gone"}}}, indent=1))
    manifest = corpus.load_manifest(spark, str(path))
    places = spark.createDataFrame([("orders", "/lake/orders")], "source_name string, location string")

    def reads(models=None):
        return lineage.dependency_reads(
            lineage.manifest_edges(manifest, models), lineage.manifest_nodes(manifest),
            lineage.manifest_sources(manifest), places, "dbt_run")

    assert rows(reads().select("table_name", "reader_job"), "table_name") == [
        ("/lake/orders", "dbt_run"), ("silver.stg_orders", "dbt_run")]
    assert rows(reads(["model.p.daily"]).select("table_name")) == [("silver.stg_orders",)]


def test_a_load_reads_new_files_only(spark, lake, rows):
    import os
    folder, root, log = lake
    drop(folder, "a.json", [order("o1", "10:00", 5.0), order("o2", "10:00", 1.0)])
    raw.ingest(spark, ORDERS, log, root, incremental=True)
    (folder / "raw/orders/a.json").write_text("{not read again")  # known by its path
    drop(folder, "b.json", [order("o2", "11:00", 2.0), order("o3", "10:00", 3.0)])
    os.utime(folder / "raw/orders/b.json", (1, 1))  # an old file that arrives late
    raw.ingest(spark, ORDERS, log, root, incremental=True)
    df = raw.ingest(spark, ORDERS, log, root, incremental=True)
    assert rows(df.select("order_id", "order_amount"), "order_id") == [("o1", 5.0), ("o2", 2.0), ("o3", 3.0)]
    runs = rows(log.runs().select("started_at", "rows_read", "rows_written"), "started_at")
    assert [r[1:] for r in runs] == [(2, 2), (2, 2), (0, 0)]


def test_files_are_loaded_in_steps(spark, lake, rows):
    folder, root, log = lake
    for n in range(5):
        drop(folder, f"{n} [x].json", [order(f"o{n}", "10:00"), order("same", f"1{n}:00", n)])
    df = raw.ingest(spark, ORDERS, log, root, incremental=True, files_at_once=2)
    assert df.count() == 6
    assert rows(df.filter("order_id = 'same'").select("order_amount")) == [(4.0,)]
    assert tables.table_history(spark, f"{root}/bronze/orders").count() == 3
    [run] = log.runs().collect()
    assert run["rows_read"] == 10


def test_a_failed_step_is_repeated(spark, lake, rows):
    folder, root, log = lake
    drop(folder, "a.json", [order("o1", "10:00")])
    (folder / "raw/orders/b.json").write_text('{"order_id": "o2", \n')
    with pytest.raises(Exception):
        raw.ingest(spark, ORDERS, log, root, incremental=True)
    drop(folder, "b.json", [order("o2", "10:00")])
    df = raw.ingest(spark, ORDERS, log, root, incremental=True)
    assert rows(df.select("order_id"), "order_id") == [("o1",), ("o2",)]
    assert sorted(r[0] for r in rows(log.runs().select("status"))) == ["failed", "success"]


def test_rows_without_a_key_stay_apart(spark, lake, rows):
    folder, root, log = lake
    drop(folder, "a.json", [order(None, "10:00", 1.0), order(None, "10:00", 2.0), order(None, "10:00", 2.0)])
    raw.ingest(spark, ORDERS, log, root, incremental=True)
    drop(folder, "b.json", [order(None, "10:00", 1.0), order(None, "10:00", 3.0)])
    df = raw.ingest(spark, ORDERS, log, root, incremental=True)
    assert rows(df.select("order_amount"), "order_amount") == [(1.0,), (2.0,), (3.0,)]


SCHEMA = "order_id string, order_amount double, updated_at timestamp"


def test_quarantine_of_json(spark, lake, rows):
    folder, root, log = lake
    spec = raw.SourceSpec("orders", "json", "raw/orders", "bronze/orders", "order_id", "updated_at", schema=SCHEMA,
                          quarantine="bad/orders")
    (folder / "raw/orders/a b.json").write_text("\n".join([
        '{"order_id": "o1", "order_amount": 1.5, "updated_at": "2024-01-01T00:00:00Z"}', "{broken", "[1, 2]", '"text"',
        '{"order_id": "o2", "order_amount": "much"}', '{"order_amount": 1}',
        '{"order_id": "o3", "order_amount": {"a": 1}, "updated_at": "never"}', '{"order_id": "o4", "other": 1}']))
    df = raw.ingest(spark, spec, log, root)
    assert rows(df.select("order_id", "order_amount"), "order_id") == [("o1", 1.5), ("o4", None)]
    bad = raw.read_quarantine(spark, spec, root)
    assert sorted(r[0] for r in rows(bad.select("reason"))) == [
        "not a JSON object", "not a JSON object", "not a JSON object", "order_amount is no double",
        "order_amount is no double, updated_at is no timestamp", "order_id is missing"]
    assert rows(bad.select("source", "record").filter("record like '%broken'")) == [("orders", "{broken")]
    assert all("a%20b.json" in r[0] for r in rows(bad.select("file")))
    assert raw.ingest(spark, spec, log, root, incremental=False).count() == 2
    assert raw.read_quarantine(spark, spec, root).select("load").distinct().count() == 2
    with pytest.raises(ValueError, match="schema"):
        raw.SourceSpec("x", "json", "a", "b", quarantine="q")


def test_quarantine_of_csv_and_repeated_steps(spark, lake, rows):
    folder, root, log = lake
    spec = raw.SourceSpec("customers", "csv", "raw/customers", "bronze/customers", "customer_id", "updated_at",
                          schema="customer_id int, region string, updated_at date", quarantine="bad/customers")
    (folder / "raw/customers/a.csv").write_text(
        "customer_id,region,updated_at\n1,eu,2024-01-01\nx,us,2024-01-01\n2,us,soon\n3,us\n4,us,2024-01-01,more\n,ap,2024-01-01\n")
    (folder / "raw/customers/b.csv").write_text("region,customer_id\nap,5\n")
    for _ in range(2):
        df = raw.ingest(spark, spec, log, root, incremental=True)
    assert rows(df.select("customer_id", "region"), "customer_id") == [(1, "eu"), (3, "us"), (5, "ap")]
    bad = raw.read_quarantine(spark, spec, root)
    assert sorted(rows(bad.select("reason", "record"))) == [
        ("customer_id is missing", ",ap,2024-01-01"), ("customer_id is no int", "x,us,2024-01-01"),
        ("more cells than columns", "4,us,2024-01-01,more"), ("updated_at is no date", "2,us,soon")]
    # A step that failed behind its quarantine and runs again leaves its rows once.
    raw._parted(spark, spec, [f"{root}/raw/customers"], f"{root}/bad/customers", "customers-0")
    assert raw.read_quarantine(spark, spec, root).count() == 4


def test_all_rejected_leaves_an_empty_table(spark, lake):
    folder, root, log = lake
    spec = raw.SourceSpec("orders", "json", "raw/orders", "bronze/orders", "order_id", "updated_at", schema=SCHEMA,
                          quarantine="bad/orders")
    (folder / "raw/orders/a.json").write_text("{broken\n")
    df = raw.ingest(spark, spec, log, root, incremental=True)
    assert df.count() == 0 and df.columns[-1] == "_ingested_at"


def test_csv_rows_of_other_lengths(spark, lake, rows):
    folder, root, _ = lake
    (folder / "raw/customers/a.csv").write_text("customer_id,region\n1\n2,eu\n")
    assert rows(raw.read_raw(spark, CUSTOMERS, root).select("customer_id", "region"), "customer_id") == [
        (1, None), (2, "eu")]
    (folder / "raw/customers/b.csv").write_text("customer_id,region\n3,us,extra\n")
    with pytest.raises(Exception, match="more cells than columns"):
        raw.read_raw(spark, CUSTOMERS, root).collect()
    (folder / "raw/customers/b.csv").write_text("customer_id,customer_id\n3,4\n")
    with pytest.raises(ValueError, match="repeats a column"):
        raw.read_raw(spark, CUSTOMERS, root)


def test_csv_cells_with_line_breaks_match_by_name(spark, lake, rows):
    folder, root, _ = lake
    spec = raw.SourceSpec("customers", "csv", "raw/customers", "b", schema="customer_id int, note string, region string",
                          options={"header": "true", "multiLine": "true", "sep": ";"})
    (folder / "raw/customers/a.csv").write_text('note;customer_id\n"two\nlines; one cell";1\n')
    (folder / "raw/customers/b.csv").write_text('customer_id;region;note\n2;eu;plain\n')
    assert rows(raw.read_raw(spark, spec, root).select("customer_id", "note", "region"), "customer_id") == [
        (1, "two\nlines; one cell", None), (2, "plain", "eu")]
