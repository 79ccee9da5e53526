"""Which treatment a column gets, by its Spark type."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The place of a row in its file, which readers attach; it is carried along and never treated as data.
ROW_ID = "_row_id"

NUMERIC, BOOL, STRING, DATETIME, OTHER = "numeric", "bool", "string", "datetime", "other"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.BooleanType):
        return BOOL
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return OTHER


def dtype_name(dtype: T.DataType) -> str:
    """Type name shown in a profile."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    return {NUMERIC: "int64", BOOL: "bool", DATETIME: "datetime"}.get(kind_of(dtype), "object")


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds and f.name != ROW_ID]


def quoted(name: str) -> Column:
    """Column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(df: DataFrame, name: str) -> Column:
    """Numeric or boolean column as double, NaN as null."""
    dtype = df.schema[name].dataType
    value = quoted(name)
    if isinstance(dtype, T.BooleanType):
        value = value.cast("int")
    value = value.cast("double")
    return F.nullif(value, F.lit(float("nan"))) if isinstance(dtype, (T.FloatType, T.DoubleType)) else value


def present(df: DataFrame, name: str) -> Column:
    """The column itself, with NaN as null for floating types."""
    value = quoted(name)
    is_float = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return F.nullif(value, F.lit(float("nan")).cast(df.schema[name].dataType)) if is_float else value
