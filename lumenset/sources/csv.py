"""CSV with a header.

Names are told apart by number where they repeat, whatever their case. While files are read their columns go by place, and the
file's path and the record that could not be read by names that no header of one line can have.
"""

import csv
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import BROADCAST_BYTES, ROW_BYTES
from ..session import ROW_ID
from .infer import cast_types, fit_types, missing_as_null
from .records import file_lines, line_breaks, read_records

FILE = "_file\n"
BAD = "_bad_record\n"
TOO_LONG = "a record has more fields than the header of its file"
OPEN_HEADER = "the header goes on over a line break"
OPEN_QUOTE = "a quoted value goes on over a line break; read the file with multi_line"


def free_names(names: list[str]) -> list[str]:
    """The names, later ones of equal names (in any case) numbered until the name is free; ``_row_id`` is never free.

    ``a,a,a.1`` become ``a,a.2,a.1``: a name that is given stays with the column that has it.
    """
    given, used, out = {n.lower() for n in names}, {ROW_ID}, []
    for name in names:
        free, number = name, 0
        while free.lower() in used or number and free.lower() in given:
            number += 1
            free = f"{name}.{number}"
        used.add(free.lower())
        out.append(free)
    return out


def header_names(line: str) -> list[str]:
    """Column names of a header line; empty ones get the number of their place."""
    return free_names([name or f"Unnamed: {place}" for place, name in enumerate(next(csv.reader([line.lstrip("\ufeff")])))])


def first_lines(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """The first line of every file that has one; only the first block of a file is looked at, one row per file comes to the driver."""
    lines = spark.read.text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.filter((F.col("at") == 0) & (F.length("value") > 0)).withColumn("id", F.monotonically_increasing_id())
    # numbers alone are aggregated: texts would be put in order, all lines of a block by one task
    ids = lines.groupBy("file").agg(F.min("id").alias("id"))
    return {r["file"]: r["value"] for r in sorted(lines.join(F.broadcast(ids), ["file", "id"]).select("file", "value").collect())}


def file_headers(spark: SparkSession, path: str | list[str], problems: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Column names of every file by its path; files without a line have none.

    A header must be one line; a file whose header is not is an error, or goes to ``problems`` with the reason.
    """
    return _headers(first_lines(spark, path), problems)


def _headers(lines: dict[str, str], problems: dict[str, str] | None = None) -> dict[str, list[str]]:
    broken = [f for f, line in lines.items() if line.count('"') % 2]
    if broken and problems is None:
        raise ValueError(f"{OPEN_HEADER}: {unquote(broken[0])}")
    if problems is not None:
        problems.update(dict.fromkeys(broken, OPEN_HEADER))
    return {f: header_names(line) for f, line in lines.items() if f not in broken}


def refers_to(value: Column) -> Column:
    """Always true. The readers refuse a query that needs nothing but the record that could not be read, so it names a value too."""
    return F.coalesce(F.length(value.cast("string")) >= 0, F.lit(True))


def _fields(record: Column) -> Column:
    """Number of fields of a raw record."""
    return F.regexp_count(F.regexp_replace(record, '"([^"]|"")*("|$)', ""), F.lit(",")) + 1


def _places(headers: dict[str, list[str]]) -> list[str]:
    lengths = {len(h) for h in headers.values()}
    # the parser marks records whose number of fields is not the schema's: with headers of several lengths, all of them
    return [f"c{i}" for i in range(max(lengths, default=0) + (len(lengths) > 1))]


def read_csv_fields(spark: SparkSession, path: str | list[str], headers: dict[str, list[str]], multi_line: bool = True) -> DataFrame:
    """All columns of all files as text by their names, the file's path in ``FILE``, and in ``BAD`` the
    records that have more fields than the header of their file.

    With ``multi_line`` one task reads a file, else lines are records.
    """
    fields = _places(headers)
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    # with columns pruned, a record of more fields than are asked for would not be marked
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").option("columnPruning", False)
    raw = reader.schema(", ".join(f"{f} string" for f in [*fields, "bad"])).csv(path)
    return _named(raw.select(*fields, F.col("bad").alias(BAD), F.col("_metadata.file_path").alias(FILE)), headers)


def _by_file(spark: SparkSession, facts: dict, field: str) -> DataFrame:
    """One row per file with a fact about it. Rows of few files stay where they are: dealt by file, those of a file would meet in one task."""
    rows = spark.createDataFrame(list(facts.items()), f"_of string, {field}")
    size = sum(len(f) + len(str(fact)) + ROW_BYTES for f, fact in facts.items())
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def _split_records(spark: SparkSession, lines: DataFrame, first: dict[str, str], headers: dict[str, list[str]]) -> DataFrame:
    """What :func:`read_csv_fields` returns and ``_row_id``, from records that many tasks have cut out of each file."""
    fields = _places(headers)
    heads = _by_file(spark, first, "_head string")
    records = read_records(lines).join(heads, F.col("file") == F.col("_of"), "left").drop("_of")
    # the first record of a file is its header, if it reads like it
    data = records.filter(~(F.col("first") & (F.col("block") == 0) & F.col("record").eqNullSafe(F.col("_head"))))
    schema = ", ".join(f"{f} string" for f in [*fields, "bad"])
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    parsed = data.select(F.from_csv("record", schema, options).alias("r"), F.col("file").alias(FILE), F.col("id").alias(ROW_ID))
    raw = parsed.select(*[F.col("r").getField(f).alias(f) for f in fields], F.col("r").getField("bad").alias(BAD), FILE, ROW_ID)
    return _named(raw, headers, ROW_ID)


def _named(raw: DataFrame, headers: dict[str, list[str]], *carried: str) -> DataFrame:
    fields = _places(headers)
    distinct = list(dict.fromkeys(map(tuple, headers.values())))
    names = list({n.lower(): n for n in dict.fromkeys(n for header in distinct for n in header)}.values())
    if len(distinct) > 1:
        kinds = _by_file(raw.sparkSession, {f: distinct.index(tuple(h)) for f, h in headers.items()}, "_kind int")
        raw = raw.join(kinds, F.col(FILE) == F.col("_of"), "left").drop("_of")
    else:
        raw = raw.withColumn("_kind", F.lit(0))
    kind = F.col("_kind")

    def by_header(make) -> Column:
        case = F.when(kind == 0, make(distinct[0]))
        for number, header in enumerate(distinct[1:], 1):
            case = case.when(kind == number, make(header))
        return case

    def value(name: str):
        def of(header) -> Column:
            place = next((i for i, n in enumerate(header) if n.lower() == name.lower()), None)
            return missing_as_null(F.col(fields[place])) if place is not None else F.lit(None).cast("string")

        return of

    if not distinct:
        return raw.select(FILE, BAD, *carried)
    too_long = F.col(BAD).isNotNull() & (_fields(F.col(BAD)) > by_header(lambda header: F.lit(len(header)))) & refers_to(F.col(fields[0]))
    bad = F.when(too_long, F.col(BAD))
    return raw.select(*[by_header(value(n)).alias(n) for n in names], F.col(FILE), bad.alias(BAD), *carried)


def check_line_breaks(spark: SparkSession, path: str | list[str]) -> None:
    """Raise if a line ends inside a quoted value: reading line by line would split that record."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    if not lines.filter(quotes % 2 == 1).isEmpty():
        raise ValueError(OPEN_QUOTE)


def read_csv_text(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """All columns as text, missing tokens as null, ``_row_id`` in scan order.

    Files are matched by the names in their headers, whatever the order; a column that a file lacks is null there. A
    record with fewer fields than the header ends in nulls, one with more is an error when the rows are read.
    Quoted values may hold line breaks. A first scan tells whether any does: if none, lines are records; if so, and a file is larger
    than a block, many tasks cut its records (:mod:`.records`). Files of one block, and files with carriage returns
    elsewhere than before line feeds, are then read by a task each. With ``multi_line=False`` a line break in a value is an error.
    """
    first = first_lines(spark, path)
    headers = _headers(first)
    rows = None
    if not multi_line:
        check_line_breaks(spark, path)
    elif headers:
        lines = file_lines(spark, path)
        breaks, returns, blocks = line_breaks(lines)
        multi_line = breaks or returns
        if breaks and blocks and not returns:
            rows = _split_records(spark, lines, first, headers)
    if rows is None:
        rows = read_csv_fields(spark, path, headers, multi_line).withColumn(ROW_ID, F.monotonically_increasing_id())
    problem = F.raise_error(F.concat(F.lit(f"{TOO_LONG}: "), FILE)).cast("boolean")
    return rows.filter(F.when(F.col(BAD).isNotNull(), problem).otherwise(True)).drop(BAD, FILE)


def read_csv_table(spark: SparkSession, path: str | list[str], multi_line: bool = True, types: dict[str, str] | None = None) -> DataFrame:
    """CSV with inferred types; with ``types`` given the inference pass is skipped."""
    text = read_csv_text(spark, path, multi_line)
    return cast_types(text, types or fit_types(text, [c for c in text.columns if c != ROW_ID]))
