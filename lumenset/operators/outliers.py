"""Outlier flags by the interquartile range."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kinds import NUMERIC, columns_of, number, quoted
from .quantiles import exact_quantiles

QUARTILES = [0.25, 0.75]
REACH = 1.5

Bounds = tuple[float, float] | None


def bounds_of(q1: float | None, q3: float | None) -> Bounds:
    if q1 is None or q3 is None:
        return None
    return q1 - REACH * (q3 - q1), q3 + REACH * (q3 - q1)


def fit_quartiles(df: DataFrame, columns: list[str], approx: bool = False) -> dict[str, list[float | None]]:
    values = {c: number(df, c) for c in columns}
    if approx:
        row = df.agg(*[F.percentile_approx(v, QUARTILES, 10_000) for v in values.values()]).first()
        return {c: list(q) if q else [None, None] for c, q in zip(columns, row)}
    return exact_quantiles(df, values, QUARTILES)


def iqr_bounds(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, q1, q3, lower, upper), one row per numeric column."""
    columns = columns_of(df, NUMERIC) if columns is None else columns
    rows = []
    for c, (q1, q3) in fit_quartiles(df, columns, approx).items():
        rows.append((c, q1, q3, *(bounds_of(q1, q3) or (None, None))))
    return df.sparkSession.createDataFrame(rows, "column string, q1 double, q3 double, lower double, upper double")


def is_outlier(value: Column, bounds: Bounds) -> Column:
    """Strictly outside the bounds; null values and columns without bounds are not outliers."""
    if bounds is None:
        return F.lit(False)
    return F.coalesce((value < bounds[0]) | (value > bounds[1]), F.lit(False))


def tag_outliers(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Add ``<column>_outlier`` for numeric columns; no row is removed."""
    columns = columns_of(df, NUMERIC) if columns is None else columns
    quartiles = fit_quartiles(df, columns, approx)
    flags = {c + "_outlier": is_outlier(number(df, c), bounds_of(*quartiles[c])) for c in columns}
    kept = [quoted(c) for c in df.columns if c not in flags]
    return df.select(*kept, *[f.alias(n) for n, f in flags.items()])
