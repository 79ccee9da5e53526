"""Frequent texts with bounded memory: counters per task, merged, and an exact recount of the candidates only.

A task keeps at most TRACKED counters per column, whatever the number of distinct values, so nothing but these is shuffled. Long
texts are counted by digest, like in :mod:`.values`.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kinds import quoted
from .values import as_text, is_digest, key_of

# Counters per column and task. Fixed by the counters: a value that is not among them has at most ERROR / TRACKED of the rows.
TRACKED = 12_000
ERROR = 3.5
# Values per column that are counted again.
CANDIDATES = 50


def counters(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(column, items, n_rows): of each column at most ``most`` frequent keys with an upper bound of their counts, null being one of them.

    One global aggregate. ``items`` are all values, with exact counts, if their counts sum to ``n_rows``.
    """
    found = lambda c: F.call_function("approx_top_k", key_of(quoted(c).cast("string")), F.lit(most), F.lit(TRACKED))
    rows = [F.struct(F.lit(c).alias("column"), found(c).alias("items"), F.count(F.lit(1)).alias("n_rows")) for c in columns]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _sum_of_counts(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda total, x: total + x["count"])


def all_values(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(column, key, n) of the columns with at most ``most`` distinct values, and no row of the others; no value is shuffled."""
    held = counters(df, columns, most + 2).where(_sum_of_counts(F.col("items")) == F.col("n_rows"))
    held = held.withColumn("items", F.filter("items", lambda x: x["item"].isNotNull())).where(F.size("items") <= most)
    return held.select("column", F.explode("items").alias("i")).select("column", F.col("i.item").alias("key"), F.col("i.count").alias("n"))


def leading_values(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The mode of each column in which it is beyond doubt: a short text whose exact count is above what any value that was not counted again can
    have. Of equal counts the smallest text. CANDIDATES counts per column come to the driver.
    """
    if not columns:
        return {}
    rows = {r["column"]: r for r in counters(df, columns, CANDIDATES).collect()}
    candidates = [(c, x["item"]) for c, r in rows.items() for x in r["items"] or [] if x["item"] is not None]
    if not candidates:
        return {}
    listed = df.sparkSession.createDataFrame(candidates, "column string, key string")
    cells = as_text(df, columns).select("column", key_of(F.col("value")).alias("key"))
    exact = cells.join(F.broadcast(listed), ["column", "key"], "left_semi").groupBy("column", "key").agg(F.count(F.lit(1)).alias("n"))
    counted = {}
    for r in exact.withColumn("long", is_digest(F.col("key"))).collect():
        counted.setdefault(r["column"], []).append((-r["n"], r["key"], r["long"]))
    modes = {}
    for c, found in counted.items():
        items, n_rows = rows[c]["items"], rows[c]["n_rows"]
        complete = sum(x["count"] for x in items) == n_rows
        # tracked values that the counters leave out have at most twice the error
        others = 0 if complete else max(2 * ERROR * n_rows / TRACKED, min(x["count"] for x in items) if len(items) == CANDIDATES else 0)
        top = min(found)[0]
        if -top > others and not any(long for n, _, long in found if n == top):
            modes[c] = min(key for n, key, _ in found if n == top)
    return modes
