import pytest
from pyspark.sql import functions as F

from lumenset.operators.clean import clean
from lumenset.operators.clean_by import clean_by


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("event_type")).alias("tenant"),
        F.expr("if(event_id % 7 = 0, null, value)").alias("value"),
        F.expr("if(event_id % 5 = 0, null, event_type)").alias("kind"),
        F.expr("if(event_id % 10 = 3, 'n/a', date_format(ts, 'dd.MM.yyyy'))").alias("day"),
    )


@pytest.mark.parametrize("group_rows, broadcast_bytes, salt_rows", [(10**9, 10**9, 10**9), (300, 0, 100), (2000, 1500, 200)])
def test_each_group_is_cleaned_like_a_table_of_its_own(spark, events, group_rows, broadcast_bytes, salt_rows):
    limits = {"group_rows": group_rows, "broadcast_bytes": broadcast_bytes, "salt_rows": salt_rows}
    got = clean_by(events, "tenant", order_by="event_id", **limits).drop("event_id_outlier")
    for tenant in [r[0] for r in events.select("tenant").distinct().collect()]:
        one = clean(events.where(F.col("tenant") == tenant), "event_id").drop("event_id_outlier")
        want = sorted(map(tuple, one.select(*one.columns).collect()))
        have = sorted(map(tuple, got.where(F.col("tenant") == tenant).select(*one.columns).collect()))
        assert have == want


def test_sketches_are_near(spark, events):
    exact = clean_by(events, "tenant", order_by="event_id")
    near = clean_by(events, "tenant", order_by="event_id", approx=True)
    assert near.dtypes == exact.dtypes
    flags = lambda df: {r.event_id: r.value_outlier for r in df.collect()}
    a, b = flags(exact), flags(near)
    assert a.keys() == b.keys() and sum(a[k] != b[k] for k in a) <= 0.01 * len(a)


def test_schema_is_fixed_and_null_key_is_a_group(spark):
    rows = [(None, 1.0, "x"), (None, None, "x"), (None, 3.0, None), ("a", 5.0, "2023-01-01"), ("a", 6.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, s string")
    out = clean_by(df, "k", order_by="v")
    assert out.columns == ["k", "v", "s", "v_outlier", "s_date"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [
            (None, 1.0, "x", False, None),
            (None, 2.0, "x", False, None),
            (None, 3.0, "x", False, None),
            ("a", 5.0, "2023-01-01", False, "2023-01-01"),
            ("a", 6.0, "2023-01-01", False, "2023-01-01"),
        ],
        key=str,
    )


def test_long_texts_fill_gaps_too(spark):
    a, b = "a" * 90, "b" * 90
    rows = [("g", 1, b), ("g", 2, a), ("g", 3, None), ("h", 1, b), ("h", 2, b), ("h", 3, "a"), ("h", 4, None), ("i", 1, a), ("i", 2, "0"), ("i", 3, None)]
    df = spark.createDataFrame(rows, "k string, i int, s string")
    got = {(r.k, r.i): r.s for r in clean_by(df, "k", order_by="i").collect()}
    assert (got["g", 3], got["h", 4], got["i", 3]) == (a, b, "0")
    for k in "ghi":
        alone = {r.i: r.s for r in clean(df.where(F.col("k") == k).drop("k"), "i").collect()}
        assert alone == {i: s for (g, i), s in got.items() if g == k}


def test_names_that_the_statistics_use_themselves(spark):
    rows = [("a", 1, 1.0, "2023-01-01"), ("a", 2, None, None), ("b", 1, 7.0, "x"), ("b", 2, 9.0, "x")]
    df = spark.createDataFrame(rows, "value string, n int, `key.x` double, column string")
    out = clean_by(df, "value", order_by="n")
    assert out.columns == ["value", "n", "key.x", "column", "n_outlier", "key.x_outlier", "column_date"]
    got = {(r["value"], r["n"]): (r["key.x"], r["column"], r["column_date"]) for r in out.collect()}
    assert got[("a", 2)] == (1.0, "2023-01-01", "2023-01-01") and got[("b", 1)] == (7.0, "x", None)
    dotted = clean_by(df, "key.x", order_by="n")
    assert dotted.count() == 4 and "n_outlier" in dotted.columns
