"""Value counts of many text columns as one table, the base of modes and string profiles.

Values are counted by a key: the value itself if it is short, else its SHA-256 digest. So whole texts
are never shuffled; the few texts that a result shows are looked up afterwards.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kinds import quoted

# Longest value that is its own key; digests are longer, so they never meet a short value.
SHORT = 64


def as_text(df: DataFrame, columns: list[str], order: Column | None = None) -> DataFrame:
    """Rows (column, value) for the given columns, values as strings; with ``order`` its value as ``at``.

    The generator makes all output columns itself, so that plans which use the rows twice are alike
    and Spark can reuse the exchange above them.
    """
    at = [] if order is None else [order.alias("at")]
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value"), *at) for c in columns]
    return df.select(F.inline(F.array(*cells))).where("value is not null")


def key_of(value: Column) -> Column:
    return F.when(F.length(value) <= SHORT, value).otherwise(F.concat(F.lit("#"), F.sha2(value, 256)))


def is_digest(key: Column) -> Column:
    return F.length(key) > SHORT


def value_counts(df: DataFrame, columns: list[str], order: Column | None = None) -> DataFrame:
    """(column, key, n) of non-null values, with ``order`` also their first place as ``seen``.

    Counted before the shuffle, so hot values stay cheap.
    """
    seen = [] if order is None else [F.min("at").alias("seen")]
    cells = as_text(df, columns, order)
    return cells.groupBy("column", key_of(F.col("value")).alias("key")).agg(F.count("*").alias("n"), *seen)


def with_values(chosen: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the ``value`` of each (column, key) to a stored table of a few of them per column.

    The source is read again only if one of them is a digest.
    """
    digests = chosen.where(is_digest(F.col("key"))).select("column", "key").distinct()
    if not digests.head(1):
        return chosen.withColumn("value", F.col("key"))
    long = as_text(df, columns).where(F.length("value") > SHORT).withColumn("key", key_of(F.col("value")))
    found = long.join(F.broadcast(digests), ["column", "key"], "left_semi")
    # a key has one value, so the set holds one text
    texts = found.groupBy("column", "key").agg(F.collect_set("value")[0].alias("text"))
    return chosen.join(texts, ["column", "key"], "left").withColumn("value", F.coalesce("text", "key")).drop("text")


def find_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest among equals; nothing for all-null columns.

    Columns with a value that clearly leads are told from bounded counters; the values of the others are counted whole. One row
    per column comes back then.
    """
    from .frequent import leading_values

    modes = leading_values(df, columns)
    columns = [c for c in columns if c not in modes]
    return modes | _counted_modes(df, columns) if columns else modes


def _counted_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    counts = value_counts(df, columns)
    long = is_digest(F.col("key"))
    best = F.min(F.when(~long, F.struct((-F.col("n")).alias("rank"), F.col("key"))))["key"]
    tops = counts.groupBy("column").agg(
        F.max("n").alias("n"), F.max(F.when(long, F.col("n"))).alias("n_long"), best.alias("short_mode")
    ).collect()
    modes = {r["column"]: r["short_mode"] for r in tops if r["n_long"] != r["n"]}
    # the rest has a long text among its most frequent values
    unique = [r["column"] for r in tops if r["n_long"] == r["n"] == 1]
    if unique:  # every value is a mode
        modes.update(zip(unique, df.agg(*[F.min(quoted(c).cast("string")) for c in unique]).first()))
    ties = {r["column"]: r["n"] for r in tops if r["n_long"] == r["n"] > 1}
    if ties:
        wanted = F.create_map(*[x for c, n in ties.items() for x in (F.lit(c), F.lit(n))])
        leading = counts.where(F.col("n") == F.try_element_at(wanted, F.col("column"))).select("column", "key")
        cells = as_text(df, list(ties)).withColumn("key", key_of(F.col("value")))
        least = cells.join(leading, ["column", "key"], "left_semi").groupBy("column").agg(F.min("value").alias("mode"))
        modes.update({r["column"]: r["mode"] for r in least.collect()})
    return modes
