from tidemill.operators.quality import check_not_null, check_unique, run_checks


def test_checks(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None), (None, "b"), (None, "b")],
                               "k int, v string")
    assert rows(check_not_null(df, "t", ["k", "v"]), "column") == [
        ("not_null", "t", "k", 2), ("not_null", "t", "v", 2)]
    # Nulls do not count as repeats; one repeated value is one failure.
    assert rows(check_unique(df, "t", ["k", "v"]), "column") == [
        ("unique", "t", "k", 1), ("unique", "t", "v", 1)]


def test_declared_checks(spark, rows):
    ids = spark.createDataFrame([(1, "o1"), (1, "o2"), (2, None)], "customer_id int, order_id string")
    frames = {"bronze.orders": ids, "bronze.customers": ids,
              "silver.stg_customers": ids.dropDuplicates(["customer_id"])}
    got = {(c, t, n): f for c, t, n, f in rows(run_checks(frames))}
    assert len(got) == 4
    assert got.pop(("not_null", "bronze.orders", "order_id")) == 1
    assert set(got.values()) == {0}


def test_unique_of_any_type(spark, rows):
    from tidemill.operators.quality import check_unique
    df = spark.createDataFrame(
        [(1, "a", 1.5, True), (1, "b", 1.5, None), (2, "b", None, None), (None, None, 0.0, None)],
        "i int, s string, d double, b boolean")
    assert rows(check_unique(df, "t", ["s", "i", "d", "b"]).select("column", "failures"), "column") == [
        ("b", 0), ("d", 1), ("i", 1), ("s", 1)]
