"""The cleaner fitted per group (file, tenant), all groups in one pass of shared jobs."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import detect_format, iso_date, parse_as
from ..functions.kinds import BOOL, NUMERIC, STRING, columns_of, kind_of, number, quoted
from ..session import cut_lineage, with_row_order
from .group_quantiles import GROUP_ROWS, group_quantiles
from .impute import UNKNOWN
from .joins import BROADCAST_BYTES, SALT_ROWS, GroupSizes, group_sizes, same_group_join, stats_join
from .outliers import REACH
from .values import is_digest, key_of

def _text_stats(df: DataFrame, keys: list[str], columns: list[str], sizes: GroupSizes, limits: dict) -> DataFrame:
    """(keys, column, fill, pattern, share): mode, date pattern and share of parsable values.

    Everything comes from value counts, which also hold where each value was first seen. Long texts
    are counted by digest; they are never dates.
    """
    texts = [quoted(c).cast("string").alias(c) for c in columns]
    long = df.select(*keys, "_order", *texts).unpivot([*keys, "_order"], [quoted(c) for c in columns], "column", "value")
    group = [*keys, "column"]
    # written once: the counts are used for the modes and again for the share of dates
    counts = cut_lineage(long.groupBy(*group, key_of(F.col("value")).alias("key")).agg(F.count("*").alias("n"), F.min("_order").alias("seen")))

    has, digest = F.col("key").isNotNull(), is_digest(F.col("key"))
    short = F.min(F.when(has & ~digest, F.struct((-F.col("n")).alias("rank"), F.col("key"))))
    sums = counts.groupBy(*group).agg(
        short["key"].alias("short_mode"),
        F.max(F.when(has, F.col("n"))).alias("top"),
        F.max(F.when(digest, F.col("n"))).alias("top_long"),
        F.count_if(~has).alias("gaps"),
        F.min(F.struct("seen", "key"))["key"].alias("first"),
    )
    # a row per group and column, written once instead of counting the values again for each use
    plans = cut_lineage(sums)
    open_ = (F.col("gaps") > 0) & (F.col("top_long") == F.col("top"))
    fill = F.coalesce("short_mode", F.lit(UNKNOWN))
    if plans.where(open_).head(1):
        texts = _long_modes(long, counts, plans.where(open_).select(*group, "top"), group)
        plans = same_group_join(plans, texts, group, "left")
        fill = F.coalesce("long_mode", fill)
    plans = plans.withColumn("fill", fill).withColumn("pattern", detect_format(F.coalesce("first", "fill")))
    plans = plans.select(*group, "fill", "pattern")

    # the patterns in use, of a few dozen that there are: a parser is made once for each of them, not for every value
    in_use = sorted(r[0] for r in plans.where("pattern is not null").select("pattern").distinct().collect())
    fits = lambda value: F.coalesce(*[F.when(F.col("pattern") == p, parse_as(F.col(value), p).isNotNull()) for p in in_use], F.lit(False))
    tested = plans.select(*group, "pattern", fits("fill").alias("fill_fits"))
    tested = _per_key(tested, keys, columns, ["pattern", "fill_fits"])
    joined = stats_join(counts.drop("seen"), tested, keys, ["column", "key"], sizes.stats_bytes(len(columns)), sizes, **limits)
    of_column = lambda field: reduce(lambda case, c: case.when(F.col("column") == c, F.col(f"`_{c}_stats`.{field}")), columns, F.when(F.lit(False), None))
    joined = joined.withColumns({"pattern": of_column("pattern"), "fill_fits": of_column("fill_fits")})
    judged = joined.withColumn(
        "valid", F.when(F.when(F.col("key").isNull(), F.col("fill_fits")).otherwise(fits("key")), F.col("n")).otherwise(0)
    )
    shares = judged.groupBy(*group).agg((F.sum("valid") / F.sum("n")).alias("share"))
    return same_group_join(plans, shares, group)


def _long_modes(cells: DataFrame, counts: DataFrame, open_: DataFrame, group: list[str]) -> DataFrame:
    """(group, long_mode) where a long text is among the most frequent values: the smallest of these."""
    tops = open_.withColumnsRenamed({g: f"_open_{g}" for g in group})
    match = [F.col(g).eqNullSafe(F.col(f"_open_{g}")) for g in group] + [F.col("n") == F.col("top")]
    leading = counts.join(tops, reduce(lambda a, b: a & b, match), "left_semi").select(*group, "key")
    leading = leading.withColumnsRenamed({g: f"_lead_{g}" for g in [*group, "key"]})
    keyed = cells.withColumn("key", key_of(F.col("value")))
    match = [F.col(g).eqNullSafe(F.col(f"_lead_{g}")) for g in group] + [F.col("key") == F.col("_lead_key")]
    found = keyed.join(leading, reduce(lambda a, b: a & b, match), "left_semi")
    return found.groupBy(*group).agg(F.min("value").alias("long_mode"))


def _per_key(stats: DataFrame, keys: list[str], columns: list[str], fields: list[str]) -> DataFrame:
    """One row per group with a struct of ``fields`` per column."""
    pick = lambda c: F.max(F.when(F.col("column") == c, F.struct(*fields))).alias(f"_{c}_stats")
    return stats.groupBy(*keys).agg(*[pick(c) for c in columns])


def clean_by(
    df: DataFrame,
    keys: str | list[str],
    order_by: str | list[str] | None = None,
    date_columns: list[str] | None = None,
    group_rows: int = GROUP_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    salt_rows: int = SALT_ROWS,
    approx: bool = False,
) -> DataFrame:
    """Impute, flag outliers and add dates with statistics of each row's own group.

    Groups of more than ``group_rows`` are counted around edges (:mod:`.group_quantiles`), statistics of more than ``broadcast_bytes`` are joined by a
    shuffle in which a group has ``salt_rows`` per task at most. With ``approx`` medians and quartiles come from one bounded sketch
    per group, whatever its size.

    The schema does not depend on the data: every text column (or those in ``date_columns``) gets
    a ``_date`` column, null throughout a group where half of the values or fewer are dates.
    """
    keys = [keys] if isinstance(keys, str) else keys
    numbers = [c for c in columns_of(df, NUMERIC) if c not in keys]
    texts = [c for c in columns_of(df, STRING, BOOL) if c not in keys]
    dates = [c for c in texts if kind_of(df.schema[c].dataType) == STRING]
    dates = dates if date_columns is None else date_columns
    spread = [quoted(c) for c in numbers + texts]

    # statistics are computed under key names that no column of theirs has
    inner = {k: f"_key{i}" for i, k in enumerate(keys)}
    ordered, order = with_row_order(df, order_by)
    base = ordered.withColumn("_order", order).withColumnsRenamed(inner)
    group = list(inner.values())
    if not numbers and not texts:
        return df
    sizes = group_sizes(base, group)
    limits = {"broadcast_bytes": broadcast_bytes, "salt_rows": salt_rows}
    per_key = []
    if numbers:
        per_key.append(group_quantiles(base, group, numbers, sizes, limits, group_rows, approx))
    if texts:
        stats = _text_stats(base, group, texts, sizes, limits)
        per_key.append(_per_key(stats, group, texts, ["fill", "pattern", "share"]))
    both = per_key[0] if len(per_key) == 1 else same_group_join(*per_key, group)
    # written once: it is measured, the patterns in use are looked up, and all rows meet the same statistics
    outer = {v: k for k, v in inner.items()}
    both = cut_lineage(both.withColumnsRenamed(outer))
    patterns, n_bytes = _measure(both, sizes, texts, dates)
    named = replace(sizes, counted=sizes.counted.withColumnsRenamed(outer))
    out = stats_join(df, both, keys, spread, n_bytes, named, **limits)
    return out.select(*_projection(df, numbers, texts, patterns))


def _measure(stats: DataFrame, sizes: GroupSizes, texts: list[str], dates: list[str]) -> tuple[dict[str, list[str]], int]:
    """Patterns per column that any group passed the gate with, and a bound on the size of ``stats``, keys and fill texts included."""
    stat = lambda c, f: F.col(f"`_{c}_stats`.{f}")
    passed = [F.collect_set(F.when(stat(c, "share") > 0.5, stat(c, "pattern"))) for c in dates]
    text_bytes = [F.coalesce(F.sum(F.octet_length(stat(c, "fill")).cast("bigint")), F.lit(0)) for c in texts]
    row = stats.agg(F.count("*"), *passed, *text_bytes).first()
    n_bytes = sizes.stats_bytes(len(stats.columns)) + sum(row[1 + len(dates) :])
    return dict(zip(dates, row[1 : 1 + len(dates)])), n_bytes


def _projection(df: DataFrame, numbers: list[str], texts: list[str], patterns: dict[str, list[str]]) -> list[Column]:
    stat = lambda c, f: F.col(f"`_{c}_stats`.{f}")
    values, flags, isos = [], [], []
    for c in df.columns:
        if c in numbers:
            value = F.coalesce(number(df, c), stat(c, "median"))
            reach = (stat(c, "q3") - stat(c, "q1")) * REACH
            outside = (value < stat(c, "q1") - reach) | (value > stat(c, "q3") + reach)
            flags.append(F.coalesce(outside, F.lit(False)).alias(c + "_outlier"))
        elif c in texts:
            kind = df.schema[c].dataType
            value = F.coalesce(quoted(c), F.expr(f"try_cast(`_{c}_stats`.fill as {kind.simpleString()})"))
        else:
            value = quoted(c)
        if c in patterns:
            tries = [F.when((stat(c, "share") > 0.5) & (stat(c, "pattern") == p), parse_as(value, p)) for p in sorted(patterns[c])]
            parsed = F.coalesce(*tries, F.lit(None).cast("timestamp"))
            isos.append(iso_date(parsed).alias(c + "_date"))
        values.append(value.alias(c))
    return values + flags + isos
