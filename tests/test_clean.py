import statistics
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenset.functions.dates import DATE_FORMATS
from lumenset.operators.clean import clean, fit_clean
from lumenset.operators.datecols import detect_date_format
from lumenset.operators.impute import impute_median, impute_mode
from lumenset.operators.outliers import iqr_bounds, tag_outliers
from lumenset.operators.quantiles import exact_quantiles


def frame(spark, schema, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid int, " + schema)


def test_common_formats_are_detected(spark):
    df = frame(
        spark,
        "ymd string, mdy string, dmy string, stamp string, words string",
        [
            ("2023-01-01", "01/15/2023", "31/01/2023", "2023-01-01 12:30:45", "abc"),
            ("2023-02-15", "02/20/2023", "28/02/2023", "2023-02-15 08:15:30", "def"),
            ("2023-03-30", "03/25/2023", "31/03/2023", "2023-03-30 18:45:10", "ghi"),
        ],
    )
    out = clean(df, "rid")
    assert {"ymd_date", "mdy_date", "dmy_date", "stamp_date"} <= set(out.columns)
    assert "words_date" not in out.columns
    first = out.orderBy("rid").first()
    assert (first.ymd_date, first.mdy_date, first.dmy_date) == ("2023-01-01", "2023-01-15", "2023-01-31")
    assert out.count() == 3


def test_each_of_the_twelve_formats(spark):
    texts = ["2023-05-04", "05/14/2023", "14/05/2023", "2023/05/04", "May 04, 2023", "04 May 2023",
             "June 04, 2023", "04 June 2023", "05-14-2023", "14-05-2023", "2023.05.04", "04.05.2023"]
    df = frame(spark, ", ".join(f"c{i} string" for i in range(12)), [tuple(texts)] * 5)
    found = {r["column"]: r["format"] for r in detect_date_format(df, order_by="rid").collect()}
    assert [found[f"c{i}"] for i in range(12)] == DATE_FORMATS
    assert {f"c{i}_date" for i in range(12)} <= set(clean(df, "rid").columns)


def test_gate_is_strictly_more_than_half(spark):
    df = frame(
        spark,
        "half string, most string, few string, blank string, empty_some string",
        [
            ("2023-01-01", "2023-01-01", "no", "", "2023-01-01"),
            ("x", "2023-02-01", "no", "", ""),
            ("2023-01-03", "not-a-date", "no", "", "2023-03-30"),
            ("y", "2023-02-03", "2023-03-30", "", "2023-03-31"),
        ],
    )
    out = clean(df, "rid")
    assert [c for c in out.columns if c.endswith("_date")] == ["most_date", "empty_some_date"]
    assert [r.most_date for r in out.orderBy("rid").collect()] == ["2023-01-01", "2023-02-01", None, "2023-02-03"]


def test_ambiguous_day_month_is_month_first(spark):
    out = clean(frame(spark, "d string", [("01/02/2023",), ("03/04/2023",)]), "rid")
    assert [r.d_date for r in out.orderBy("rid").collect()] == ["2023-01-02", "2023-03-04"]


def test_first_row_null_takes_the_mode_as_sample(spark):
    df = frame(spark, "d string", [(None,), ("05.01.2023",), ("06.01.2023",), ("05.01.2023",)])
    out = clean(df, "rid").orderBy("rid").collect()
    assert [r.d for r in out][0] == "05.01.2023"
    assert [r.d_date for r in out] == ["2023-01-05", "2023-01-05", "2023-01-06", "2023-01-05"]


def test_dates_outside_the_nanosecond_range_fail(spark):
    out = clean(frame(spark, "d string", [("2023-01-01",), ("1500-01-01",), ("2023-01-02",)]), "rid")
    assert [r.d_date for r in out.orderBy("rid").collect()] == ["2023-01-01", None, "2023-01-02"]


def test_median_of_even_count_and_all_null(spark):
    df = frame(spark, "a int, b double", [(1, None), (4, None), (None, None), (2, None), (10, None)])
    out = impute_median(df).orderBy("rid").collect()
    assert [r.a for r in out] == [1.0, 4.0, 3.0, 2.0, 10.0]
    assert all(r.b is None for r in out)
    assert dict(impute_median(df).dtypes)["a"] == "double"


def test_integers_without_gaps_stay_integers(spark):
    assert dict(clean(frame(spark, "a bigint", [(1,), (2,)]), "rid").dtypes)["a"] == "bigint"


def test_mode_tie_takes_smallest_and_all_null_is_unknown(spark):
    df = frame(spark, "a string, b string, c boolean", [("y", None, True), ("x", None, None), (None, None, False), ("y", None, True), ("x", None, True)])
    out = impute_mode(df).orderBy("rid").collect()
    assert [r.a for r in out] == ["y", "x", "x", "y", "x"]
    assert {r.b for r in out} == {"Unknown"}
    assert out[1].c is True


def test_outliers_are_strict_and_null_is_false(spark):
    df = frame(spark, "a double", [(1.0,), (2.0,), (3.0,), (4.0,), (None,), (100.0,)])
    bounds = iqr_bounds(df, ["a"]).first()
    q1, q3 = np.quantile([1, 2, 3, 4, 100], [0.25, 0.75])
    assert (bounds.q1, bounds.q3) == (q1, q3)
    assert [r.a_outlier for r in tag_outliers(df, ["a"]).orderBy("rid").collect()] == [False] * 5 + [True]


def test_zero_range_flags_everything_else(spark):
    df = frame(spark, "a int", [(5,)] * 8 + [(6,)])
    assert sum(r.a_outlier for r in clean(df, "rid").collect()) == 1


def test_nan_counts_as_missing(spark):
    df = frame(spark, "a double", [(float("nan"),), (1.0,), (3.0,)])
    assert [r.a for r in clean(df, "rid").orderBy("rid").collect()] == [2.0, 1.0, 3.0]


def test_cleaning_twice(spark):
    df = frame(spark, "d string, a double", [("2023-01-01", 1.0), ("2023-01-02", 2.0), ("x", 3.0)])
    once = clean(df, "rid")
    twice = clean(once, "rid")
    assert twice.columns == ["rid", "d", "a", "rid_outlier", "a_outlier", "d_date", "d_date_date"]
    assert [r.d_date_date for r in twice.orderBy("rid").collect()] == ["2023-01-01", "2023-01-02", None]


def test_empty_table(spark):
    out = clean(frame(spark, "d string, a double", []), "rid")
    assert out.columns == ["rid", "d", "a", "rid_outlier", "a_outlier"] and out.count() == 0


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "2023-01-01"), (2, None)], "`a.b` int, `my date` string")
    out = clean(df).collect()
    assert {r["my date_date"] for r in out} == {"2023-01-01"}


@pytest.mark.parametrize("shape", ["uniform", "ties", "tails"])
def test_narrowing_is_exact(spark, shape):
    rng = np.random.default_rng(3)
    data = {
        "uniform": rng.random(30_000),
        "ties": np.where(rng.random(30_000) < 0.6, 7.0, np.round(rng.random(30_000) * 14, 4)),
        "tails": np.exp(rng.normal(size=30_000) * 12),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in data], "v double").repartition(8)
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = exact_quantiles(df, {"v": F.col("v")}, probs, direct_rows=100)
    assert found["v"] == pytest.approx(list(np.quantile(data, probs)), rel=1e-12)


def test_model_same_for_both_quantile_paths(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("value", F.expr("if(event_id % 7 = 0, null, value)"))
    assert fit_clean(df, "event_id") == fit_clean(df, "event_id", direct_rows=1000)
    for exact, near in zip(fit_clean(df, "event_id").columns, fit_clean(df, "event_id", approx=True).columns):
        if exact.bounds:
            assert near.bounds == pytest.approx(exact.bounds, rel=0.01, abs=1)
