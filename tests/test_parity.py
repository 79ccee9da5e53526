"""The same inputs through pandas functions and through the operators."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lumenset.functions.dates import DATE_FORMATS, parse_one
from lumenset.operators.clean import clean
from lumenset.operators.profile import numeric_summary
from lumenset.plans.cleaning import SQL_FORMATS

TRICKY = [
    "2023-01-05", "2023-1-5", "2023-13-01", "2023-02-30", "2024-02-29", "2023-02-29", "23-01-05", "12023-01-05", " 2023-01-05",
    "2023-01-05 ", "2023-01-05x", "2023-01-05 10:00:00", "01/02/2023", "1/2/2023", "13/02/2023", "02/13/2023", "31/12/1999",
    "00/01/2023", "2023/1/5", "2023/01/05", "Jan 05, 2023", "jan 5, 2023", "JAN 05, 2023", "January 5, 2023", "May 5, 2023",
    "5 May 2023", "05 Jan 2023", "5 january 2023", "Sept 5, 2023", "Sep 5, 2023", "01-02-2023", "31-01-2023", "2023.01.05",
    "2023.1.5", "05.01.2023", "5.1.2023", "32.01.2023", "1600-01-01", "2500-01-01", "1677-09-22", "2262-04-11", "", "abc", "20230105",
]


def test_each_format_accepts_what_pandas_accepts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "i int, t string")
    row = df.select("i", "t", *[F.date_format(parse_one(F.col("t"), p), "yyyy-MM-dd").alias(f"f{k}") for k, p in enumerate(DATE_FORMATS)])
    got = row.orderBy("i").collect()
    different = []
    for k, fmt in enumerate(SQL_FORMATS):
        want = pd.to_datetime(pd.Series(TRICKY), format=fmt, errors="coerce").dt.strftime("%Y-%m-%d")
        for i, text in enumerate(TRICKY):
            expected = None if pd.isna(want[i]) else want[i]
            if got[i][f"f{k}"] != expected:
                different.append((fmt, text, got[i][f"f{k}"], expected))
    assert not different


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6).map(lambda v: round(v, 2)), st.integers(-50, 50).map(float)), min_size=1, max_size=40))
def test_filled_numbers_and_flags(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = clean(df, "i").orderBy("i").collect()
    series = pd.Series(values, dtype="float64")
    filled = series.fillna(series.median())
    q1, q3 = filled.quantile(0.25), filled.quantile(0.75)
    reach = 1.5 * (q3 - q1)
    for row, value in zip(got, filled):
        if np.isnan(value):
            assert row.v is None and row.v_outlier is False
            continue
        assert row.v == pytest.approx(value, rel=1e-12, abs=1e-9)
        near = min(abs(value - (q1 - reach)), abs(value - (q3 + reach))) < 1e-6
        assert near or row.v_outlier == bool(value < q1 - reach or value > q3 + reach)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "B", "é", ""])), min_size=1, max_size=25))
def test_filled_text(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    series = pd.Series(values, dtype="object")
    mode = series.mode()
    want = series.fillna(mode[0] if not mode.empty else "Unknown").tolist()
    assert [r.v for r in clean(df, "i").orderBy("i").collect()] == want


def test_numeric_summary(spark):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(500) < 0.2, np.nan, rng.normal(size=500) * 100)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = numeric_summary(df).first()
    series = pd.Series(values)
    want = [series.min(), series.max(), series.mean(), series.median(), series.std()]
    assert [row[k] for k in ("min", "max", "mean", "median", "std")] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize(
    "values",
    [
        ["2023-01-05 12:30:45", "2023-02-06 01:02:03", "2023-02-07 00:00:00", "2023-02-30 00:00:00"],
        ["2023-01-05T12:30:45", "2023-02-06T01:02:03", "2023-02-07"],
        ["2023-01-05T23:30:45Z", "2023-02-06T01:02:03Z"],
        ["2023-01-05 12:30", "2023-02-06 23:59", "2023-02-06 24:10"],
        ["01/05/2023 12:30", "02/16/2023 01:02"],
        ["01/05/2023 12:30:11", "02/16/2023 01:02:12"],
        ["05-Jan-2023", "16-Feb-2023", "31-Feb-2023"],
        ["20230105", "20230216", "20231301"],
        ["2023-01", "2023-12", "2023-13"],
        ["2023-01-05 12:30:45.123456", "2023-02-06 01:02:03.000001"],
    ],
)
def test_default_parser_shapes(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = clean(df, "i").orderBy("i")
    want = pd.to_datetime(pd.Series(values), errors="coerce").dt.strftime("%Y-%m-%d")
    assert "v_date" in out.columns
    assert [r.v_date for r in out.collect()] == [None if pd.isna(w) else w for w in want]
