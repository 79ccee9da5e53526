"""Average ranks of many columns without a window over a whole table, and correlations of them."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.kinds import NUMERIC, columns_of, number
from ..session import cut_lineage
from .feeds import correlations

# Cells of one value that one task may join; the ranks of values with more are broadcast.
HOT_ROWS = 100_000


def value_ranks(cells: DataFrame) -> DataFrame:
    """(column, value, n, rank) of (column, value) cells: how often the value occurs, and its average place, from 1, among all of its column.

    Distinct values with their counts are range-partitioned, so that every task orders a run of them; the places before a run are
    the sums of the runs before, of which there is one row per task and column.
    """
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # written once: sums and places must see the same runs
    runs = cut_lineage(counts.repartitionByRange("column", "value").withColumn("run", F.spark_partition_id()))
    totals = runs.groupBy("column", "run").agg(F.sum("n").alias("all"))
    earlier = F.sum("all").over(W.partitionBy("column").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select("column", "run", F.coalesce(earlier, F.lit(0)).alias("before"))
    upto = F.sum("n").over(W.partitionBy("column", "run").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    placed = runs.withColumn("upto", upto).join(offsets, ["column", "run"])
    # a value of n rows that ends at place e has the places e - n + 1 to e
    return placed.select("column", "value", "n", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def ranked_columns(df: DataFrame, columns: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row that has a value in any of the columns, each value replaced by its average rank in its column; nulls stay null.

    Equal values have equal ranks. Cells meet the ranks of their column by a join on the value: the ranks of frequent values, few by their
    count, are broadcast, only cells of the others are shuffled. Cells come back together by the number of their row.
    """
    columns = columns_of(df, NUMERIC) if columns is None else columns
    cells = [F.struct(F.lit(i).alias("column"), number(df, c).alias("value")) for i, c in enumerate(columns)]
    # written once, narrow: rows are numbered, and both the ranks and the join read the numbers
    rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("row"), F.filter(F.array(*cells), lambda x: x["value"].isNotNull()).alias("cells")))
    long = rows.select("row", F.inline("cells"))
    ranks = cut_lineage(value_ranks(long.select("column", "value")))
    hot = ranks.where(F.col("n") > hot_rows).select(F.col("column").alias("_c"), F.col("value").alias("_v"), "rank")
    marked = long.join(F.broadcast(hot), (F.col("column") == F.col("_c")) & (F.col("value") == F.col("_v")), "left").drop("_c", "_v")
    rest = marked.where("rank is null").drop("rank").join(ranks.where(F.col("n") <= hot_rows).drop("n"), ["column", "value"])
    ranked = marked.where("rank is not null").unionByName(rest)
    back = ranked.groupBy("row").agg(*[F.max(F.when(F.col("column") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(columns))])
    return back.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(columns)])


def rank_correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, r, n) for every pair of numeric columns: the correlation of average ranks over the rows where both are present.

    A value's rank is that among all present values of its column. A constant column, or a pair that never meets, gives null.
    """
    columns = columns_of(df, NUMERIC) if columns is None else columns
    if len(columns) < 2:
        return correlations(df, columns)
    return correlations(cut_lineage(ranked_columns(df, columns)), columns)
