import json
import math

import pytest
from pyspark.sql import functions as F

from lumenset.operators import feeds
from lumenset.operators.quality import duplicate_rows, quality_report


def test_records_keep_null_keys(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, "x\"y", 1.5)], "i int, s string, d double")
    got = sorted((json.loads(r.record) for r in feeds.records_json(df).collect()), key=lambda r: r["i"])
    assert got == [{"i": 1, "s": None, "d": None}, {"i": 2, "s": 'x"y', "d": 1.5}]


def test_categories_with_nulls_and_a_real_other(spark):
    rows = [("a", 5.0), ("a", 5.0), (None, 7.0), ("Other", 1.0), ("b", 2.0), ("c", None)]
    got = {(r.category, r.is_other): (r.n, r.total, r.share) for r in feeds.by_category(spark.createDataFrame(rows, "k string, v double"), "k", "v", 2).collect()}
    assert got == {("a", False): (2, 10.0, 0.5), (None, False): (1, 7.0, 0.35), ("Other", True): (3, 3.0, 0.15)}


def test_correlation_of_partial_and_constant_columns(spark):
    rows = [(1.0, 2.0, 1.0, None), (2.0, 4.0, 1.0, 1.0), (3.0, 6.5, 1.0, None), (None, 9.0, 1.0, 3.0)]
    got = {(r.x, r.y): (r.r, r.n) for r in feeds.correlations(spark.createDataFrame(rows, "a double, b double, c double, d double")).collect()}
    assert got[("a", "c")] == (None, 3) and got[("a", "d")] == (None, 1) and got[("c", "d")][0] is None
    assert got[("a", "b")][1] == 3 and math.isclose(got[("a", "b")][0], 0.99794872, rel_tol=1e-6)


def test_filters_combine(spark):
    df = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(10)], "i int, k string")
    got = feeds.apply_filters(df, {"k": ["x"]}, {"i": (2, 6)})
    assert sorted(r.i for r in got.collect()) == [2, 4, 6]
    assert feeds.apply_filters(df).count() == 10


def test_scatter_is_repeatable(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"), F.col("id").alias("y"))
    once = sorted(map(tuple, feeds.scatter(df, "x", "y", "k", 50).collect()))
    assert len(once) == 50 and once == sorted(map(tuple, feeds.scatter(df.repartition(5), "x", "y", "k", 50).collect()))


def test_week_starts_on_monday(spark):
    df = spark.sql("select timestamp'2024-01-03 10:00:00' t, 2.0D v union all select timestamp'2024-01-07 23:00:00', 4.0D union all select timestamp'2024-01-08', 1.0D")
    got = {(str(r.bucket)[:10]): (r.n, r.total, r.mean) for r in feeds.by_time(df, "t", "week", "v").collect()}
    assert got == {"2024-01-01": (2, 6.0, 3.0), "2024-01-08": (1, 1.0, 1.0)}


def test_quality_of_a_clean_and_a_bad_table(spark):
    clean = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "i int, s string")
    assert quality_report(clean, order_by="i").count() == 0
    bad = spark.createDataFrame(
        [(1.0, "k", "2023-01-01"), (1.0, "k", "2023-01-01"), (None, "k", "2023-01-02"), (2.0, "k", "soon"), (900.0, "k", "2023-01-03"), (3.0, "k", None)],
        "v double, c string, d string",
    )
    got = {(r.issue_type, tuple(r.affected_columns)): r.description for r in quality_report(bad, order_by="v").collect()}
    assert got == {
        ("missing values", ("v",)): "1 of 6 values are missing",
        ("missing values", ("d",)): "1 of 6 values are missing",
        ("constant column", ("c",)): "all values are equal",
        ("outliers", ("v",)): "1 of 6 values lie outside the interquartile fences",
        ("unparsable dates", ("d",)): "1 of 5 values do not match yyyy-M-d",
        ("duplicate rows", ("v", "c", "d")): "1 of 6 rows repeat another row",
    }


@pytest.mark.parametrize("copies", [1, 400])
def test_duplicates_with_nulls_and_a_hot_row(spark, copies):
    rows = [(None, "a")] * 3 + [(1, "b")] * copies + [(2, None), (3, "c")]
    assert duplicate_rows(spark.createDataFrame(rows, "i int, s string").repartition(4)) == 2 + copies - 1
