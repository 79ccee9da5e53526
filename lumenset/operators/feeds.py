"""The tables behind a dashboard: rows as JSON, KPIs and chart aggregates."""

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.kinds import NUMERIC, columns_of, number, quoted
from .profile import _stacked
from .quantiles import aggregate_row

OTHER = "Other"
# Pairs of columns that one aggregate sums up.
PAIRS_AT_ONCE = 200


def records_json(df: DataFrame) -> DataFrame:
    """One JSON object per row; nulls keep their key, NaN is written as null."""
    values = [F.nullif(quoted(n), F.lit(float("nan"))).alias(n) if t in ("double", "float") else quoted(n) for n, t in df.dtypes]
    return df.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("record"))


def kpis(df: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, n, total, mean, min, max), one row per measure."""
    aggregates = {}
    for c in measures:
        v = number(df, c)
        aggregates[c] = [F.count(v), F.sum(v), F.avg(v), F.min(v), F.max(v)]
    return _stacked(df, aggregates, ["n", "total", "mean", "min", "max"]).withColumnRenamed("column", "measure")


def by_category(df: DataFrame, dimension: str, measure: str, n: int = 10) -> DataFrame:
    """(category, is_other, n, total, share): the n largest categories, the rest as one row.

    Everything is a partial aggregate but the join of the sums, one row per category, with the n leading ones.
    """
    sums = df.groupBy(quoted(dimension).alias("category")).agg(F.count("*").alias("n"), F.sum(number(df, measure)).alias("total"))
    return leaders(sums, n)


def leaders(sums: DataFrame, n: int) -> DataFrame:
    """The n largest of sums (category, n, total), one row per category, and the others as one row, with shares."""
    # ordering by all columns keeps both uses of the sums alike, so they are computed once
    first = sums.orderBy(F.desc_nulls_last("total"), F.asc_nulls_last("category"), "n").limit(n)
    marked = first.select(F.col("category").alias("_leader"), F.lit(True).alias("_leads"))
    joined = sums.join(marked, F.col("category").eqNullSafe(F.col("_leader")), "left")
    is_other = F.col("_leads").isNull()
    grouped = joined.groupBy(F.when(is_other, F.lit(OTHER)).otherwise(F.col("category")).alias("category"), is_other.alias("is_other")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    # at most n + 1 rows are left for the total
    return grouped.withColumn("share", F.try_divide("total", F.sum("total").over(W.partitionBy())))


def by_time(df: DataFrame, ts: str, grain: str, measure: str) -> DataFrame:
    """(bucket, n, total, mean) per day, week (from Monday), month, ..."""
    bucket = F.date_trunc(grain, quoted(ts).cast("timestamp")).alias("bucket")
    v = number(df, measure)
    return df.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"))


def by_two(df: DataFrame, rows: str, columns: str, measure: str) -> DataFrame:
    """(row, column, n, total): the cells of a heatmap."""
    return df.groupBy(quoted(rows).alias("row"), quoted(columns).alias("column")).agg(
        F.count("*").alias("n"), F.sum(number(df, measure)).alias("total")
    )


def scatter(df: DataFrame, x: str, y: str, key: str, n: int = 1000) -> DataFrame:
    """(key, x, y): n points that a hash of the key picks, the same ones every time."""
    points = df.where(quoted(x).isNotNull() & quoted(y).isNotNull())
    chosen = points.select(quoted(key).alias("key"), quoted(x).alias("x"), quoted(y).alias("y"))
    return chosen.orderBy(F.md5(F.col("key").cast("string")), "key").limit(n)


def apply_filters(df: DataFrame, isin: dict[str, list] | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
    """Dashboard filters: categories in a list, values in a closed range (an end may be None)."""
    tests: list[Column] = [quoted(c).isin(list(values)) for c, values in (isin or {}).items()]
    for c, (low, high) in (between or {}).items():
        tests += [quoted(c) >= F.lit(low)] if low is not None else []
        tests += [quoted(c) <= F.lit(high)] if high is not None else []
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, r, n) for every pair of numeric columns over the rows where both are present.

    One scan finds the middle of every column, further ones sum up products of the distances from it, for at most
    PAIRS_AT_ONCE pairs each; rows are not multiplied. A constant column gives null.
    """
    columns = columns_of(df, NUMERIC) if columns is None else columns
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "x string, y string, r double, n bigint")
    middles = aggregate_row(df, [e for c in columns for e in (F.avg(number(df, c)), F.min(number(df, c)), F.max(number(df, c)))])
    # the middle of a constant is the constant itself
    middle = [low if low == high else avg for avg, low, high in zip(middles[::3], middles[1::3], middles[2::3])]
    centred = df.select(*[(number(df, c) - F.lit(m).cast("double")).alias(f"v{i}") for i, (c, m) in enumerate(zip(columns, middle))])
    parts = []
    for start in range(0, len(pairs), PAIRS_AT_ONCE):
        aggregates = []
        for i, j in pairs[start : start + PAIRS_AT_ONCE]:
            a, b = F.col(f"v{i}"), F.col(f"v{j}")
            both = (a * b).isNotNull()
            sums = [F.sum(F.when(both, v)).alias(name) for name, v in (("a", a), ("b", b), ("ab", a * b), ("aa", a * a), ("bb", b * b))]
            aggregates.append(F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), F.count(a * b).alias("n"), *sums))
        parts.append(centred.agg(F.array(*aggregates).alias("rows")).select(F.inline("rows")))
    found = reduce(DataFrame.unionByName, parts)
    spread = {v: F.col(v * 2) - F.try_divide(F.col(v) * F.col(v), F.col("n")) for v in "ab"}
    spread = {v: F.when(s > F.col(v * 2) * 1e-12, s) for v, s in spread.items()}
    r = F.try_divide(F.col("ab") - F.try_divide(F.col("a") * F.col("b"), F.col("n")), F.sqrt(spread["a"]) * F.sqrt(spread["b"]))
    return found.select("x", "y", r.alias("r"), "n")
