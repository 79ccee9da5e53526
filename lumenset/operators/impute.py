"""Fill missing values: median for numbers, mode for text."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kinds import BOOL, NUMERIC, STRING, columns_of, kind_of, number, quoted
from .quantiles import aggregate_row, exact_quantiles
from .values import find_modes

# Fixed value: stands in for a text column without any value.
UNKNOWN = "Unknown"


def null_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    row = aggregate_row(df, [F.count_if(_value(df, c).isNull()) for c in columns]) if columns else []
    return dict(zip(columns, row))


def _value(df: DataFrame, name: str) -> Column:
    return number(df, name) if kind_of(df.schema[name].dataType) == NUMERIC else quoted(name)


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, {c: number(df, c) for c in columns}, [0.5]).items()}


def fit_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Mode per column as text."""
    found = find_modes(df, columns) if columns else {}
    return {c: found.get(c, UNKNOWN) for c in columns}


def filled(df: DataFrame, name: str, fill) -> Column:
    """Column with its fill value; numeric columns that had nulls become double."""
    if kind_of(df.schema[name].dataType) == NUMERIC:
        return F.coalesce(number(df, name), F.lit(fill).cast("double")).alias(name)
    return F.coalesce(quoted(name), F.lit(fill).cast(df.schema[name].dataType)).alias(name)


def _apply(df: DataFrame, fills: dict) -> DataFrame:
    return df.select([filled(df, c, fills[c]) if c in fills else quoted(c) for c in df.columns])


def impute_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace nulls of numeric columns by the column median; an all-null column stays null."""
    columns = columns_of(df, NUMERIC) if columns is None else columns
    missing = [c for c, n in null_counts(df, columns).items() if n]
    return _apply(df, fit_medians(df, missing)) if missing else df


def impute_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace nulls of text and boolean columns by the mode, smallest value among equals."""
    columns = columns_of(df, STRING, BOOL) if columns is None else columns
    missing = [c for c, n in null_counts(df, columns).items() if n]
    fills = fit_modes(df, missing)
    # an all-null boolean column has no mode and nothing to fall back to
    fills = {c: v for c, v in fills.items() if not (v == UNKNOWN and c in columns_of(df, BOOL))}
    return _apply(df, fills) if fills else df
