"""JSON records, keyed JSON documents and name-based date conversion."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.dates import parse_any
from ..functions.kinds import NUMERIC, STRING, kind_of, quoted
from ..operators.quantiles import aggregate_row
from ..session import ROW_ID, cut_lineage
from .csv import free_names, refers_to

KEY = "_key"
BAD = "_bad_record\n"
NOT_JSON = "the text is not JSON"
NO_TABLE = "a document must be a list or an object"
MIXED_LIST = "a list must hold objects only, or plain values only"
# The column of a list of plain values.
VALUES = "0"
# Most fields that the objects of one table may have; a table of more columns can't be planned.
MAX_FIELDS = 10_000

# Columns converted to timestamps by their lower-case name.
DATE_NAMES = ["modified", "date", "datetime"]
DATE_ENDINGS = ["_at", "_time"]
DATE_STARTS = ["timestamp"]
# Smallest number taken for an epoch time; per unit the largest one in the nanosecond range and its microseconds.
MIN_EPOCH = 31_536_000
EPOCH_UNITS = [
    (9_223_372_036, "1000000"),
    (9_223_372_036_854, "1000"),
    (9_223_372_036_854_775, "1"),
    (9_223_372_036_854_775_807, "0.001"),
]


def read_json_records(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = False,
    convert_date_names: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame:
    """One row per object: JSON lines by default, files that hold one list of objects with ``multi_line``.

    Nested values stay as JSON text, integer columns with gaps become doubles. A field named like the ``_row_id`` that is attached
    here, or like another in another case, is numbered. Anything else than objects is an error, found
    when the schema is inferred or the rows are read. With ``schema`` given the passes that infer types are skipped.
    """
    reader = spark.read.option("multiLine", multi_line).option("columnNameOfCorruptRecord", BAD)
    inferred = schema or reader.json(path).schema
    if BAD in inferred.names:
        raise ValueError(MIXED_LIST if multi_line else NOT_JSON)
    nested = (T.StructType, T.ArrayType, T.MapType)
    fields = [T.StructField(f.name, T.StringType() if isinstance(f.dataType, nested) else f.dataType) for f in inferred.fields]
    read = reader.schema(T.StructType([*fields, T.StructField(BAD, T.StringType())])).json(path)
    problem = F.raise_error(F.lit(MIXED_LIST if multi_line else NOT_JSON)).cast("boolean")
    fine = refers_to(quoted(fields[0].name)) if fields else F.lit(True)
    out = read.filter(F.when(F.col(BAD).isNotNull() & fine, problem).otherwise(True)).drop(BAD)
    integers = [f.name for f in fields if isinstance(f.dataType, T.LongType)]
    if integers and schema is None:
        gaps = aggregate_row(out, [F.count_if(quoted(c).isNull()) for c in integers])
        out = out.withColumns({c: quoted(c).cast("double") for c, n in zip(integers, gaps) if n})
    out = out.toDF(*free_names(out.columns)).withColumn(ROW_ID, F.monotonically_increasing_id())
    return convert_named_dates(out) if convert_date_names else out


def read_json_documents(spark: SparkSession, path: str | list[str], convert_date_names: bool = False) -> DataFrame:
    """Files that each hold one JSON document of any shape, flattened by :func:`flatten_keyed_json`."""
    files = spark.read.option("wholetext", True).text(path)
    rows = flatten_keyed_json(files, "value")
    if KEY in rows.columns and not rows.where(F.col(KEY).isNotNull()).head(1):
        rows = rows.drop(KEY)
    out = rows.toDF(*free_names(rows.columns)).withColumn(ROW_ID, F.monotonically_increasing_id())
    return convert_named_dates(out) if convert_date_names else out


def parsed_document(text: Column) -> Column:
    """The variant of a JSON text, null for other texts. ``NaN`` and ``Infinity`` are numbers, which plain JSON has not."""
    return F.coalesce(F.try_parse_json(text), F.from_json(text, "variant"))


def _list(value: Column) -> Column:
    """Elements of a variant list, null for anything else."""
    return value.try_cast("array<variant>")


def members_of(value: Column) -> Column:
    """Members of a variant object, null for anything else."""
    return value.try_cast("map<string,variant>")


def _are_objects(items: Column) -> Column:
    return F.forall(items, lambda x: members_of(x).isNotNull())


def document_problem(document: Column) -> Column:
    """Why a variant document is no table, null if it is one."""
    items = _list(document)
    plain = F.forall(items, lambda x: members_of(x).isNull() & _list(x).isNull())
    mixed = items.isNotNull() & ~_are_objects(items) & ~plain
    other = items.isNull() & members_of(document).isNull()
    return F.when(document.isNull(), NOT_JSON).when(mixed, MIXED_LIST).when(other, NO_TABLE)


def document_rows(document: Column) -> Column:
    """Variant document to an array of (key, row).

    A list of objects gives these, a list of plain values rows of one column; a dictionary with list or dictionary values gives
    the objects found there under their key, dropping everything else; a flat dictionary is one row. Anything
    else is an error (see document_problem).
    """
    keyed = lambda key: lambda x: F.struct(key.alias("key"), x.alias("row"))
    no_key = F.lit(None).cast("string")
    none = F.array().cast("array<struct<key:string,row:variant>>")
    objects = lambda items: F.filter(items, lambda x: members_of(x).isNotNull())

    def under_key(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        return (
            F.when(_list(value).isNotNull(), F.transform(objects(_list(value)), keyed(key)))
            .when(members_of(value).isNotNull(), F.array(keyed(key)(value)))
            .otherwise(none)
        )

    entries = F.map_entries(members_of(document))
    is_nested = F.exists(entries, lambda e: _list(e["value"]).isNotNull() | members_of(e["value"]).isNotNull())
    plain_row = lambda x: keyed(no_key)(F.to_variant_object(F.struct(x.alias(VALUES))))
    return (
        F.when(document_problem(document).isNotNull(), F.raise_error(document_problem(document)).cast("array<struct<key:string,row:variant>>"))
        .when(_list(document).isNotNull() & _are_objects(_list(document)), F.transform(_list(document), keyed(no_key)))
        .when(_list(document).isNotNull(), F.transform(_list(document), plain_row))
        .when(is_nested, F.flatten(F.transform(entries, under_key)))
        .otherwise(F.array(keyed(no_key)(document)))
    )


def column_type(variant_type: str) -> str:
    base = variant_type.split("(")[0].split("<")[0]
    if base in ("BIGINT", "BOOLEAN"):
        return base.lower()
    return "double" if base in ("DOUBLE", "FLOAT", "DECIMAL") else "string"


def document_fields(rows: DataFrame) -> dict[str, str]:
    """Column types of variant rows by field name; at most MAX_FIELDS rows come back."""
    fields = rows.select(F.explode(members_of(F.col("row"))).alias("field", "value"))
    found = fields.groupBy("field").agg(F.schema_of_variant_agg("value").alias("type")).limit(MAX_FIELDS + 1).collect()
    if len(found) > MAX_FIELDS:
        raise ValueError(f"the objects have more than {MAX_FIELDS} fields; are they keyed by an id?")
    return {r["field"]: column_type(r["type"]) for r in sorted(found)}


def flatten_keyed_json(df: DataFrame, json_col: str, fields: dict[str, str] | None = None) -> DataFrame:
    """One row per object found in the documents of ``json_col``; the other columns are repeated.

    Rows from a keyed document carry their key in ``_key``, which replaces a field of that name.
    With ``fields`` (name to type) given, the pass that finds them is skipped; with none, the objects stay whole in ``_row``.
    """
    carried = [quoted(c) for c in df.columns if c != json_col]
    listed = document_rows(parsed_document(quoted(json_col)))
    rows = df.select(*carried, F.explode(listed).alias("_item")).select(*carried, F.col("_item.key").alias("_found"), F.col("_item.row").alias("row"))
    if fields == {}:
        return rows.select(*carried, F.col("_found").alias(KEY), F.col("row").alias("_row"))
    if fields is None:
        # stored once: the fields are found first, and documents need not be parsed again for the rows
        rows = cut_lineage(rows)
        fields = document_fields(rows)
    as_map = members_of(F.col("row"))
    missing = lambda value, kind: F.nullif(value, F.lit(float("nan"))) if kind == "double" else value
    value = lambda name, kind: missing(F.try_element_at(as_map, F.lit(name)).try_cast(kind), kind)
    key = F.coalesce("_found", value(KEY, "string")) if KEY in fields else F.col("_found")
    return rows.select(*carried, *[value(n, t).alias(n) for n, t in fields.items() if n != KEY], key.alias(KEY))


def is_date_name(name: str) -> bool:
    lower = name.lower()
    return lower in DATE_NAMES or lower.endswith(tuple(DATE_ENDINGS)) or lower.startswith(tuple(DATE_STARTS))


def convert_named_dates(df: DataFrame) -> DataFrame:
    """Columns whose name says date become timestamps if every value converts, else stay as they are."""
    named = [f for f in df.schema.fields if is_date_name(f.name) and kind_of(f.dataType) in (STRING, NUMERIC)]
    if not named:
        return df
    tests = []
    for f in named:
        c = quoted(f.name)
        if kind_of(f.dataType) == STRING:
            tests += [F.count_if(c.isNotNull() & parse_any(c).isNull()), F.lit(None), F.count(c)]
        else:
            tests += [F.count_if(c.cast("double") <= MIN_EPOCH), F.max(c.cast("double")), F.count(c)]
    row = iter(aggregate_row(df, tests))
    converted = {}
    for f in named:
        c, bad, high, present = quoted(f.name), next(row), next(row), next(row)
        if bad or not present:
            continue
        if kind_of(f.dataType) == STRING:
            converted[f.name] = parse_any(c)
        else:
            unit = next((u for limit, u in EPOCH_UNITS if high <= limit), None)
            if unit:
                micros = c.cast("decimal(25,6)") * F.lit(unit).cast("decimal(10,3)")
                converted[f.name] = F.timestamp_micros(micros.cast("bigint"))
    return df.withColumns(converted) if converted else df
