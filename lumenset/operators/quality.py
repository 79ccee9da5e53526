"""Data-quality issues of a table."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import ANY_FORMAT, parse_as
from ..functions.kinds import NUMERIC, ROW_ID, STRING, columns_of, number, present, quoted
from .datecols import fit_formats, passes
from .outliers import bounds_of, fit_quartiles, is_outlier
from .quantiles import aggregate_row

ISSUE_SCHEMA = "issue_type string, description string, affected_columns array<string>"


def _row_key(df: DataFrame, columns: list[str]) -> list[Column]:
    """128 bits of a row: two hashes of its values and of which of them are null."""
    values = []
    for c in columns:
        kind, value = df.schema[c].dataType, quoted(c)
        if isinstance(kind, T.MapType):
            # entries in a fixed order
            value = F.array_sort(F.transform(F.map_entries(value), lambda e: F.to_json(F.struct(e), {"ignoreNullFields": "false"})))
        if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
            value = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        values.append(value)
    # a hash passes over nulls, so their places are hashed as well
    gaps = [quoted(c).isNull() for c in columns]
    return [F.xxhash64(F.lit(seed), *values, *gaps).alias(f"_key{seed}") for seed in (1, 2)]


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> int:
    """Rows that repeat an earlier row.

    One aggregate over 128 bits per row, counted before the shuffle; rows themselves are not shuffled.
    """
    columns = [c for c in df.columns if c != ROW_ID] if columns is None else columns
    copies = df.select(*_row_key(df, columns)).groupBy("_key1", "_key2").agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]


def quality_report(df: DataFrame, order_by=None, min_outlier_share: float = 0.0, columns: list[str] | None = None) -> DataFrame:
    """(issue_type, description, affected_columns), one row per finding about the given columns, all by default.

    Missing values, constant columns, outliers, columns of which more than half are dates but not all,
    and repeated rows. The findings are a few counts per column.
    """
    columns = [c for c in df.columns if c != ROW_ID] if columns is None else columns
    numbers, texts = ([c for c in columns_of(df, kind) if c in columns] for kind in (NUMERIC, STRING))
    quartiles = fit_quartiles(df, numbers) if numbers else {}
    formats = {c: f for c, f in fit_formats(df, texts, order_by).items() if f}

    # null <> min is null, so this counts differing values only
    lowest, highest = [F.min(present(df, c)) for c in columns], [F.max(present(df, c)) for c in columns]
    same = [a.eqNullSafe(b) & a.isNotNull() for a, b in zip(lowest, highest)]
    counts = [F.count(F.lit(1))] + [F.count(present(df, c)) for c in columns]
    outside = [F.count_if(is_outlier(number(df, c), bounds_of(*quartiles[c]))) for c in numbers]
    unparsed = [F.count_if(quoted(c).isNotNull() & parse_as(quoted(c), f).isNull()) for c, f in formats.items()]
    row = iter(aggregate_row(df, counts + same + outside + unparsed))

    n = next(row)
    issues = []
    values = {c: next(row) for c in columns}
    for c, k in values.items():
        if k < n:
            issues.append(("missing values", f"{n - k} of {n} values are missing", [c]))
    for c in columns:
        if next(row):
            issues.append(("constant column", "all values are equal", [c]))
    for c in numbers:
        k = next(row)
        if k and k / n > min_outlier_share:
            issues.append(("outliers", f"{k} of {n} values lie outside the interquartile fences", [c]))
    for c in formats:
        k = next(row)
        # the rule of the date gate: more than half of all rows
        if k and passes((values[c] - k) / n):
            expected = "are no dates" if formats[c] == ANY_FORMAT else f"do not match {formats[c]}"
            issues.append(("unparsable dates", f"{k} of {values[c]} values {expected}", [c]))
    copies = duplicate_rows(df, columns)
    if copies:
        issues.append(("duplicate rows", f"{copies} of {n} rows repeat another row", columns))
    return df.sparkSession.createDataFrame(issues, ISSUE_SCHEMA)
