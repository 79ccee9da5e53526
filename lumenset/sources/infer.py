"""Column types from text: integer, double, boolean, else text."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kinds import STRING, columns_of, quoted
from ..operators.quantiles import aggregate_row

# The texts that mean "no value".
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# The texts read as booleans.
TRUE_TEXTS, FALSE_TEXTS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]

# Texts of more characters are told by patterns alone, which fail at their first letter.
LONG = 40
# Number texts. The match comes first: a failing cast is slow, and casts take forms such as "5d" too.
INTEGER = r"^\s*[+-]?\d+\s*$"
DOUBLE = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def missing_as_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING), text)


def as_integer(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def as_double(text: Column) -> Column:
    return F.when(text.rlike(DOUBLE), text.try_cast("double"))


def as_boolean(text: Column) -> Column:
    return F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)


CASTS = {"bigint": as_integer, "double": as_double, "boolean": as_boolean, "string": lambda text: text}


# What a value can be read as, narrowest first.
KINDS = ["bigint", "double", "boolean", "string"]


def _kind(text: Column, rest: Column) -> Column:
    """Place in :data:`KINDS` of the narrowest type of one value, null for a missing value.

    ``rest`` is the text without its digits, null for long texts. It tells plain numbers and most other texts; patterns are
    tried on long texts and the few that may be numbers of another form, with an exponent or spaces.
    """
    signed = rest.isin("+", "-", "+.", "-.") & F.substring(text, 1, 1).isin("+", "-")
    plain = (F.length(rest) < F.length(text)) & (rest.isin("", ".") | signed)
    fits = (F.length(text) <= 18) | text.try_cast("bigint").isNotNull()
    other = F.length(F.translate(rest, "+-.eE \t\n\r\f\x0binfINFtyTY", "")) == 0
    bigint, double, string = (F.lit(KINDS.index(k)) for k in ("bigint", "double", "string"))
    place = F.when(text.isNull(), None).when(plain & F.contains(rest, F.lit(".")), double).when(plain, F.when(fits, bigint).otherwise(double))
    place = place.when(as_boolean(text).isNotNull(), F.lit(KINDS.index("boolean"))).when(~other, string)
    return place.when(text.rlike(INTEGER) & fits, bigint).when(text.rlike(DOUBLE), double).otherwise(string)


def fit_types(df: DataFrame, columns: list[str] | None = None) -> dict[str, str]:
    """Narrowest type per text column that holds all its values; one aggregate for all columns."""
    columns = columns_of(df, STRING) if columns is None else columns
    kinds, tests = _tests(df, columns)
    return _types(columns, aggregate_row(kinds, tests))


def fit_types_of(tables: dict[str, DataFrame]) -> dict[str, dict[str, str]]:
    """:func:`fit_types` for the text columns of several tables in one job; one row per table comes back."""
    parts, columns = [], {}
    for name, df in tables.items():
        columns[name] = columns_of(df, STRING)
        kinds, tests = _tests(df, columns[name])
        parts.append(kinds.agg(F.array(*[t.cast("long") for t in tests]).alias("found")).select(F.lit(name).alias("name"), "found"))
    rows = reduce(DataFrame.unionByName, parts).collect() if parts else []
    return {r["name"]: _types(columns[r["name"]], r["found"]) for r in rows}


def fit_types_by(df: DataFrame, key: str, columns: list[str]) -> dict[str, dict[str, str]]:
    """:func:`fit_types` for every value of a key column, such as the file of a row; one row per value comes back."""
    kinds, tests = _tests(df, columns, quoted(key).alias("_of"))
    return {r["_of"]: _types(columns, r[1:]) for r in kinds.groupBy("_of").agg(*tests).collect()}


def _tests(df: DataFrame, columns: list[str], *carried: Column) -> tuple[DataFrame, list[Column]]:
    rest = lambda text: F.when(F.length(text) <= LONG, F.translate(text, "0123456789", ""))
    texts = [t for i, c in enumerate(columns) for t in (quoted(c).alias(f"t{i}"), rest(quoted(c)).alias(f"r{i}"))]
    cells = df.select(*carried, *texts)
    kinds = cells.select(*cells.columns[: len(carried)], *[_kind(F.col(f"t{i}"), F.col(f"r{i}")).alias(f"k{i}") for i in range(len(columns))])
    return kinds, [F.count(F.lit(1)), *[t for i in range(len(columns)) for t in (F.count(f"k{i}"), F.min(f"k{i}"), F.max(f"k{i}"))]]


def _types(columns: list[str], row) -> dict[str, str]:
    types = {}
    for i, c in enumerate(columns):
        present, low, high = row[1 + 3 * i : 4 + 3 * i]
        if not row[0]:
            types[c] = "string"
        elif not present:
            types[c] = "double"
        elif high <= 1:  # integers with gaps are doubles
            types[c] = "bigint" if high == 0 and present == row[0] else "double"
        else:
            types[c] = "boolean" if low == high == 2 else "string"
    return types


def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select([CASTS[types[c]](quoted(c)).alias(c) if c in types else quoted(c) for c in df.columns])


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast text columns to the types found by :func:`fit_types`."""
    return cast_types(df, fit_types(df, columns))
