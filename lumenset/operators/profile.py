"""Per-column statistics of a table.

All numeric statistics come from one aggregate; all string statistics from one value-count table.
Rows carry ``position``, the place of the column in the table.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.kinds import BOOL, DATETIME, NUMERIC, STRING, columns_of, dtype_name, number, quoted
from ..session import ROW_ID, cut_lineage, with_row_order
from .frequent import all_values
from .quantiles import exact_quantiles
from .values import value_counts, with_values

# A text column with fewer distinct values than this shows its most frequent ones.
MANY_VALUES = 10
TOP_VALUES = 5
EXAMPLES = 3

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def table_shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns), one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def _stacked(df: DataFrame, aggregates: dict[str, list[Column]], fields: list[str]) -> DataFrame:
    """One aggregate pass over ``df``, turned into one row (column, *fields) per column."""
    structs = []
    for name, values in aggregates.items():
        parts = [F.lit(name).alias("column"), *[v.alias(f) for v, f in zip(values, fields)]]
        structs.append(F.struct(*parts))
    return df.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))


def numeric_summary(df: DataFrame, columns: list[str] | None = None, **limits) -> DataFrame:
    """(column, min, max, mean, median, std) of numeric and boolean columns; std is the sample one."""
    columns = columns_of(df, NUMERIC, BOOL) if columns is None else columns
    medians = exact_quantiles(df, {c: number(df, c) for c in columns}, [0.5], **limits)
    aggregates = {}
    for c in columns:
        v = number(df, c)
        median = F.lit(medians[c][0]).cast("double")
        aggregates[c] = [F.min(v), F.max(v), F.avg(v), median, F.stddev_samp(v)]
    return _stacked(df, aggregates, ["min", "max", "mean", "median", "std"])


def datetime_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, first, last) of date and timestamp columns as ISO-8601 text."""
    columns = columns_of(df, DATETIME) if columns is None else columns
    return _stacked(df, {c: [iso(F.min(quoted(c))), iso(F.max(quoted(c)))] for c in columns}, ["first", "last"])


def iso(value: Column) -> Column:
    """ISO-8601 text, with microseconds only where there are any."""
    stamp = value.cast("timestamp")
    micros = F.date_format(stamp, "SSSSSS")
    return F.concat(F.date_format(stamp, ISO_SECONDS), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, unique_values) of text columns, nulls ignored."""
    columns = columns_of(df, STRING) if columns is None else columns
    if approx:
        return _stacked(df, {c: [F.approx_count_distinct(quoted(c))] for c in columns}, ["unique_values"])
    listed = _all_columns(df, columns).join(_distinct(value_counts(df, columns)), "column", "left")
    return listed.select("column", F.coalesce("unique_values", F.lit(0)).alias("unique_values"))


def _all_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = [(c, df.columns.index(c)) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, position int")


# The parts below that share one table of value counts all read the same columns of it, so that
# Spark computes and shuffles it once and reuses the exchange.


def _distinct(values: DataFrame) -> DataFrame:
    seen = F.col("seen").isNotNull() if "seen" in values.columns else F.lit(True)
    return values.groupBy("column").agg(F.count_if((F.col("n") > 0) & seen).alias("unique_values"))


def _first_k(values: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k values per column; the row limit is applied before the shuffle as well."""
    return values.withColumn("place", F.row_number().over(W.partitionBy("column").orderBy(*order))).where(F.col("place") <= k)


def _shown_values(df: DataFrame, columns: list[str], order_by, max_distinct: int, examples: int) -> DataFrame:
    """(column, unique_values, use, value, n, seen): the values that a profile may show.

    All values (``top``) of a column with fewer than ``max_distinct``, the first ones in row order
    (``early``) of a column with more. Stored, since it is small and used in several places.
    """
    ordered, order = with_row_order(df, order_by)
    values = value_counts(ordered, columns, order)
    by_count, by_place = [F.desc("n"), F.asc("key"), F.asc("seen")], [F.asc("seen"), F.desc("n")]
    top = _first_k(values, by_count, max_distinct - 1).withColumn("use", F.lit("top"))
    early = _first_k(values, by_place, examples).withColumn("use", F.lit("early"))
    few = F.col("unique_values") < max_distinct
    both = top.unionByName(early).join(_distinct(values), "column").where(F.when(few, F.col("use") == "top").otherwise(F.col("use") == "early"))
    return with_values(cut_lineage(both.drop("place")), df, columns)


def _top(shown: DataFrame, k: int) -> DataFrame:
    return _first_k(shown.where("use = 'top'"), [F.desc("n"), F.asc("value")], k)


def top_values(df: DataFrame, k: int = TOP_VALUES, max_distinct: int = MANY_VALUES, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n, place) of text columns with 1 to ``max_distinct - 1`` distinct values.

    Told from bounded counters: columns of more values cost no shuffle of them.
    """
    columns = columns_of(df, STRING) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, place int")
    shown = with_values(cut_lineage(all_values(df, columns, max_distinct - 1)), df, columns)
    return _first_k(shown, [F.desc("n"), F.asc("value")], k).select("column", "value", "n", "place")


def _examples(shown: DataFrame) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("seen", "value")))["value"]
    return shown.where("use = 'early'").groupBy("column").agg(listed.alias("examples"))


def example_values(df: DataFrame, n: int = EXAMPLES, max_distinct: int = MANY_VALUES, order_by=None, columns: list[str] | None = None) -> DataFrame:
    """(column, example_values): the first distinct values in row order of columns with many values,
    an empty list for columns without any."""
    columns = columns_of(df, STRING) if columns is None else columns
    shown = _shown_values(df, columns, order_by, max_distinct, n)
    few = shown.where("use = 'top'").select("column").distinct()
    listed = _all_columns(df, columns).join(few, "column", "left_anti").join(_examples(shown), "column", "left")
    return listed.select("column", F.coalesce("examples", F.array().cast("array<string>")).alias("example_values"))


def profile_table(df: DataFrame, order_by=None, **limits) -> DataFrame:
    """One row per column: name, type and the statistics that its type calls for."""
    base = df.drop(ROW_ID)
    rows = [(i, f.name, dtype_name(f.dataType)) for i, f in enumerate(base.schema.fields)]
    out = df.sparkSession.createDataFrame(rows, "position int, name string, type string")

    numbers, stamps, texts = columns_of(base, NUMERIC, BOOL), columns_of(base, DATETIME), columns_of(base, STRING)
    parts = []
    if numbers:
        parts.append(numeric_summary(base, numbers, **limits))
    if stamps:
        parts.append(datetime_summary(base, stamps))
    if texts:
        parts.append(_text_summary(df, texts, order_by))
    empty = df.sparkSession.createDataFrame([], PROFILE_FIELDS)
    stats = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, empty)
    return out.join(stats.withColumnRenamed("column", "name"), "name", "left").select(
        "position", "name", "type", *[f for f in stats.columns if f != "column"]
    )


PROFILE_FIELDS = (
    "column string, min double, max double, mean double, median double, std double, first string, last string, "
    "unique_values bigint, top_values map<string,bigint>, example_values array<string>"
)


def _text_summary(df: DataFrame, columns: list[str], order_by) -> DataFrame:
    shown = _shown_values(df, columns, order_by, MANY_VALUES, EXAMPLES)
    entries = F.sort_array(F.collect_list(F.struct("place", "value", "n")))
    pairs = F.transform(entries, lambda e: F.struct(e["value"].alias("value"), e["n"].alias("n")))
    top = _top(shown, TOP_VALUES).groupBy("column").agg(F.map_from_entries(pairs).alias("top_values"))
    counts = shown.groupBy("column").agg(F.max("unique_values").alias("unique_values"))
    listed = _all_columns(df, columns).join(counts, "column", "left").join(top, "column", "left").join(_examples(shown), "column", "left")
    no_examples = F.when(F.col("top_values").isNull(), F.array().cast("array<string>"))
    return listed.select(
        "column",
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        "top_values",
        F.coalesce("examples", no_examples).alias("example_values"),
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """Name and type per column only, for tables whose statistics cannot be computed."""
    rows = [(i, f.name, dtype_name(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def column_json(profile: DataFrame, decimals: int | None = None) -> DataFrame:
    """(position, name, info): each column's statistics as the JSON object of the profile document.

    With ``decimals`` numbers are written with so many places instead of as they are.
    """
    if decimals is not None:
        numbers = ["min", "max", "mean", "median", "std"]
        profile = profile.withColumns({c: F.round(c, decimals).cast(f"decimal(38,{decimals})") for c in numbers})
    as_json = lambda *fields: F.to_json(F.struct("type", "name", *fields), {"ignoreNullFields": "false"})
    info = (
        F.when(F.col("type") == "datetime", as_json(F.col("first").alias("min"), F.col("last").alias("max")))
        .when(F.col("top_values").isNotNull(), as_json("unique_values", "top_values"))
        .when(F.col("unique_values").isNotNull(), as_json("unique_values", "example_values"))
        .when(F.col("type").isin("int64", "float64", "bool"), as_json("min", "max", "mean", "median", "std"))
        .otherwise(as_json())
    )
    return profile.select("position", "name", info.alias("info"))


def profile_json(df: DataFrame, original_filename: str, file_type: str, order_by=None, decimals: int | None = None) -> DataFrame:
    """One row with the profile document of the table."""
    base = df.drop(ROW_ID)
    head = F.struct(
        F.lit(original_filename).alias("original_filename"),
        F.lit(file_type).alias("file_type"),
        F.lit(base.count()).alias("n_rows"),
        F.lit(len(base.columns)).alias("n_columns"),
    )
    # a JSON list of one text without its brackets is that text quoted
    name = F.regexp_replace(F.to_json(F.array("name")), r"^\[|\]$", "")
    member = F.concat(name, F.lit(":"), F.col("info"))
    members = column_json(profile_table(df, order_by), decimals).select("position", member.alias("member"))
    # one entry per column of the table, so the list is as long as the schema
    listed = F.sort_array(F.collect_list(F.struct("position", "member")))["member"]
    opening = F.regexp_replace(F.to_json(head), r"\}$", "")
    return members.agg(F.array_join(listed, ",").alias("body")).select(
        F.concat(opening, F.lit(',"column_info":{'), F.col("body"), F.lit("}}")).alias("document")
    )


def _first_rows(df: DataFrame, n: int, order_by) -> DataFrame:
    """The first n rows with their place as ``_order``. Without a key rows are taken as they are scanned, and
    the scan stops with them; only a key makes the whole table be read."""
    if order_by is None:
        first = df.limit(n)
        return first.withColumn("_order", quoted(ROW_ID) if ROW_ID in df.columns else F.monotonically_increasing_id())
    ordered, order = with_row_order(df, order_by)
    return ordered.withColumn("_order", order).orderBy("_order").limit(n)


def preview(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    """The first n rows, by ``order_by`` or as they are scanned."""
    return _first_rows(df, n, order_by).select(*[quoted(c) for c in df.columns if c != ROW_ID])


def excerpt(df: DataFrame, fmt: str = "csv", chars: int = 2000, order_by=None) -> DataFrame:
    """One row with the first characters of the table written as CSV or JSON records, ``...`` if cut.

    A written row is at least one character long, so no more than ``chars`` rows are looked at, and of each no
    more than what is left when every row before it has one character.
    """
    names = [c for c in df.columns if c != ROW_ID]
    first = _first_rows(df, chars + 1, order_by)
    body = F.struct(*[quoted(c) for c in names])
    if fmt == "csv":
        line = F.to_csv(body, {"quote": '"', "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss"})
        head, separator, tail = ",".join(names) + "\n", "\n", "\n"
    else:
        line = F.to_json(body, {"ignoreNullFields": "false"})
        head, separator, tail = "[", ",", "]"
    lines = F.sort_array(F.collect_list(F.struct("_order", F.substring(line, 1, chars + 1).alias("line"))))["line"]
    text = F.concat(F.lit(head), F.array_join(lines, separator), F.lit(tail))
    return first.agg(text.alias("text")).select(
        F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("..."))).otherwise(F.col("text")).alias("excerpt")
    )
