"""Queries of the readers and writers, on files that are first written from the tables."""


from functools import reduce

from pyspark.sql import functions as F

from ..operators.clean import fit_clean
from ..operators.profile import schema_profile
from ..session import ROW_ID, scratch_path
from ..sources.csv import read_csv_table
from ..sources.infer import cast_types, fit_types_of, infer_types
from ..sources.json import convert_named_dates, document_problem, flatten_keyed_json, read_json_documents, read_json_records
from ..sources.registry import Upload, add_existing, read_datasets
from ..sources.sinks import register_dataset, take_upload, write_table
from ..sources.uploads import check_uploads
from .tables import CATALOG, catalog, read, text


def _with(body):
    return f"with {CATALOG} {body}"

GAPPY_ORDERS = """
    select o_orderkey, case when o_orderkey % 7 = 0 then null else o_custkey end as o_custkey,
           case when o_orderkey % 5 = 0 then null else o_totalprice end as o_totalprice,
           case when o_orderkey % 4 = 0 then null else o_orderpriority end as o_orderpriority,
           o_orderstatus = 'O' as is_open, 'said "' || o_orderstatus || '", twice' as note,
           strftime(o_orderdate, '%Y-%m-%d') as day from orders"""


def gappy_orders(spark, folder):
    key = F.col("o_orderkey")
    return read(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 5 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 4 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        (F.col("o_orderstatus") == "O").alias("is_open"),
        F.concat(F.lit('said "'), "o_orderstatus", F.lit('", twice')).alias("note"),
        text("yyyy-MM-dd", "o_orderdate").alias("day"),
    )


def csv_orders(spark, folder):
    """Written as CSV with missing tokens, read back with inferred types."""
    path = scratch_path(spark, "csv")
    tokens = {"o_custkey": "NA", "o_totalprice": "NaN", "o_orderpriority": "n/a"}
    orders = gappy_orders(spark, folder)
    orders = orders.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(t)) for c, t in tokens.items()})
    write_table(orders, path, "csv")
    return read_csv_table(spark, path).drop(ROW_ID)


# customer keys with gaps come back as doubles
CSV_ORDERS = f"select * replace (cast(o_custkey as double) as o_custkey) from ({GAPPY_ORDERS})"


def json_orders(spark, folder):
    path = scratch_path(spark, "json")
    orders = gappy_orders(spark, folder)
    nested = F.struct(F.col("o_orderkey").alias("k"), F.array("is_open").alias("flags"))
    # a field of the name that readers attach themselves; it is written by Spark, as write_table leaves it out
    given = (F.col("o_orderkey") * 2).alias(ROW_ID)
    orders.select("*", nested.alias("detail"), given).write.option("ignoreNullFields", False).json(path)
    return read_json_records(spark, path).drop(ROW_ID).withColumnRenamed(f"{ROW_ID}.1", "given_row_id")


JSON_ORDERS = f"""
select * replace (cast(o_custkey as double) as o_custkey),
       '{{"k":' || o_orderkey || ',"flags":[' || case when is_open then 'true' else 'false' end || ']}}' as detail, o_orderkey * 2 as given_row_id
from ({GAPPY_ORDERS})"""

def csv_multiline(spark, folder):
    """Notes with line breaks, commas and quotes, written as CSV and read back."""
    path = scratch_path(spark, "csv")
    note = F.concat(F.lit("first, \n"), "o_orderpriority", F.lit('\n\n"last" line of '), "o_orderkey")
    write_table(read(spark, folder, "orders").select("o_orderkey", note.alias("note"), "o_totalprice"), path, "csv")
    return read_csv_table(spark, path).drop(ROW_ID)


def csv_split_notes(spark, folder):
    """Line items with notes over several lines, in files larger than a block: many tasks cut the records of each."""
    path = scratch_path(spark, "csv")
    lines = read(spark, folder, "lineitem")
    note = F.concat(F.lit('"'), "l_returnflag", F.lit('",\n\n'), text("yyyy-MM-dd", "l_shipdate"), F.lit('\nk,"'), F.repeat(F.lit("-\n"), F.col("l_linenumber").cast("int")))
    broken = F.when(F.col("l_orderkey") % 3 == 0, F.concat("l_returnflag", F.lit(' "plain"'))).otherwise(note)
    write_table(lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", broken.alias("note"), "l_extendedprice"), path, "csv")
    return read_csv_table(spark, path).drop(ROW_ID)


CSV_SPLIT_NOTES = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
       case when l_orderkey % 3 = 0 then l_returnflag || ' "plain"'
            else '"' || l_returnflag || '",' || chr(10) || chr(10) || strftime(l_shipdate, '%Y-%m-%d') || chr(10) || 'k,"' || repeat('-' || chr(10), cast(l_linenumber as bigint)) end as note,
       l_extendedprice
from lineitem"""


CSV_MULTILINE = """
select o_orderkey, 'first, ' || chr(10) || o_orderpriority || chr(10) || chr(10) || '"last" line of ' || o_orderkey as note, o_totalprice from orders"""


def csv_many_headers(spark, folder):
    """One folder of files with other column orders, fewer columns and shorter records."""
    path = scratch_path(spark, "csv")
    orders = read(spark, folder, "orders")
    for i, columns in enumerate((["o_orderkey", "o_custkey", "o_orderpriority"], ["o_orderpriority", "o_orderkey", "o_custkey"], ["o_custkey", "o_orderkey"])):
        write_table(orders.filter(F.col("o_orderkey") % 3 == i).select(columns), path, "csv", "append")
    return read_csv_table(spark, path).drop(ROW_ID)


CSV_MANY_HEADERS = "select o_orderkey, o_custkey, case when o_orderkey % 3 < 2 then o_orderpriority end as o_orderpriority from orders"


def json_mixed_list(spark, folder):
    """Documents that are lists of plain values, one per order status and thousand order keys; the list that also holds an object is refused."""
    path = scratch_path(spark, "documents")
    keys = F.to_json(F.sort_array(F.collect_list("o_orderkey")))
    part = F.floor(F.col("o_orderkey") / 1000).alias("part")
    read(spark, folder, "orders").groupBy("o_orderstatus", part).agg(keys.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = read_json_documents(spark, path).drop(ROW_ID)
    mixed = read(spark, folder, "region").agg(F.concat(F.lit("[1,"), F.max(F.to_json(F.struct("r_name"))), F.lit("]")).alias("value"))
    why = mixed.select(document_problem(F.parse_json("value"))).first()[0]
    return rows.agg(F.count("0").alias("n"), F.sum("0").alias("total")).withColumn("why", F.lit(why))


JSON_MIXED_LIST = "select count(*) as n, cast(sum(o_orderkey) as bigint) as total, 'a list must hold objects only, or plain values only' as why from orders"

TYPED = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations",
]
# what the values of each table look like once they are text
SQL_TYPES = {"BIGINT": "bigint", "INTEGER": "bigint", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "string"}


def _as_text(df):
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def column_types(spark, folder):
    """Types found again after every column of every table was turned into text."""
    tables = {t: _as_text(read(spark, folder, t)).withColumn("gaps", F.lit(None).cast("string")) for t in TYPED}
    found = [(t, c, kind) for t, types in fit_types_of(tables).items() for c, kind in types.items()]
    return spark.createDataFrame(found, "table_name string, column string, type string")


COLUMN_TYPES = " union all ".join(
    [
        f"select '{t}' as table_name, name as \"column\", case "
        + " ".join(f"when type = '{k}' then '{v}'" for k, v in SQL_TYPES.items())
        + f" end as type from pragma_table_info('{t}')"
        for t in TYPED
    ]
    + [f"select '{t}', 'gaps', 'double'" for t in TYPED]
)


DESCRIBED = TYPED
SQL_NAMES = {"BIGINT": "int64", "INTEGER": "int64", "DOUBLE": "float64", "VARCHAR": "object", "TIMESTAMP": "object"}


def described_tables(spark, folder):
    """Name and type per column of tables whose types are found from their texts."""
    tables = {t: _as_text(read(spark, folder, t)) for t in DESCRIBED}
    types = fit_types_of(tables)
    parts = [schema_profile(cast_types(df, types[t])).withColumn("table_name", F.lit(t)) for t, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


DESCRIBED_TABLES = " union all ".join(
    f"select '{t}' as table_name, cast(cid as integer) as position, name, case "
    + " ".join(f"when type = '{k}' then '{v}'" for k, v in SQL_NAMES.items())
    + f" end as type from pragma_table_info('{t}')"
    for t in DESCRIBED
)


def typed_orders(spark, folder):
    return infer_types(_as_text(gappy_orders(spark, folder)))


TYPED_ORDERS = CSV_ORDERS

# --- documents --------------------------------------------------------------------------------


def _documents(spark, folder):
    """One JSON document per event, of a shape that follows from its key."""
    key = F.col("event_id")
    x = F.concat(F.lit('{"x":'), key, F.lit("}"))
    y = F.concat(F.lit('{"y":"'), "event_type", F.lit('","_key":"old"}'))
    v = F.concat(F.lit('{"x":'), F.col("user_id"), F.lit(',"v":'), F.col("value"), F.lit("}"))
    doc = (
        F.when(key % 4 == 0, F.concat(F.lit('{"a":['), x, F.lit(","), v, F.lit(',5],"b":'), y, F.lit(',"c":7}')))
        .when(key % 4 == 1, F.concat(F.lit("["), x, F.lit(","), v, F.lit("]")))
        .when(key % 4 == 2, F.concat(F.lit('{"x":'), key, F.lit(',"y":"'), "event_type", F.lit('"}')))
        .otherwise(F.concat(F.lit('{"only":'), y, F.lit("}")))
    )
    return read(spark, folder, "events").select("event_id", doc.alias("doc"))


def _plain(rows):
    return rows.withColumns({"x": F.coalesce("x", F.lit(-1)), "y": F.coalesce("y", F.lit("")), "_key": F.coalesce("_key", F.lit(""))})


def event_documents(spark, folder):
    return _plain(flatten_keyed_json(_documents(spark, folder), "doc"))


EVENT_DOCUMENTS = """
with e as (select *, event_id % 4 as shape from events)
select event_id, event_id as x, '' as y, cast(null as double) as v, case shape when 0 then 'a' else '' end as _key from e where shape in (0, 1)
union all select event_id, user_id, '', value, case shape when 0 then 'a' else '' end from e where shape in (0, 1)
union all select event_id, -1, event_type, null, case shape when 0 then 'b' else 'only' end from e where shape in (0, 3)
union all select event_id, event_id, event_type, null, '' from e where shape = 2"""


def document_files(spark, folder):
    """Files of one document each, which holds a thousand customers keyed by market segment."""
    path = scratch_path(spark, "documents")
    customers = read(spark, folder, "customer").select(
        F.floor(F.col("c_custkey") / 1000).alias("part"), "c_mktsegment", F.to_json(F.struct("c_custkey", "c_acctbal")).alias("item")
    )
    lists = customers.groupBy("part", "c_mktsegment").agg(F.concat_ws(",", F.collect_list("item")).alias("items"))
    member = F.concat(F.lit('"'), "c_mktsegment", F.lit('":['), "items", F.lit("]"))
    whole = lists.groupBy("part").agg(F.concat(F.lit('{"n":1,'), F.concat_ws(",", F.collect_list(member)), F.lit("}")).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json_documents(spark, path).drop(ROW_ID)


DOCUMENT_FILES = "select c_acctbal, c_custkey, c_mktsegment as _key from customer"


def named_dates(spark, folder):
    stamp = F.col("ts").cast("timestamp")
    events = read(spark, folder, "events").select(
        "event_id",
        F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.unix_seconds(stamp).alias("start_time"),
        F.unix_millis(stamp).alias("timestamp_ms"),
        F.when(F.col("event_id") % 100 == 1, "soon").otherwise(F.date_format(stamp, "yyyy-MM-dd")).alias("modified"),
        F.col("value").alias("lead_time"),
    )
    shown = convert_named_dates(events)
    millis = {"timestamp_ms": "yyyy-MM-dd HH:mm:ss.SSS"}
    return shown.select([
        F.date_format(c, millis.get(c, "yyyy-MM-dd HH:mm:ss")).alias(c) if kind == "timestamp" else F.col(c)
        for c, kind in shown.dtypes
    ])


NAMED_DATES = """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at, strftime(ts, '%Y-%m-%d %H:%M:%S') as start_time,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%g') as timestamp_ms,
       case when event_id % 100 = 1 then 'soon' else strftime(ts, '%Y-%m-%d') end as modified, value as lead_time
from events"""

# --- registration -----------------------------------------------------------------------------


def registered_tables(spark, folder):
    """The stored table of datasets after three cleaned tables, in three formats, were registered behind the existing ones."""
    table = scratch_path(spark, "datasets")
    add_existing(table, catalog(spark, folder).datasets)
    for t, fmt in (("customer", "csv"), ("part", "json"), ("lineitem", "parquet")):
        rows = read(spark, folder, t)
        cleaned = fit_clean(rows).transform(rows)
        register_dataset(cleaned, table, Upload(1, f"{t}.{fmt}", scratch_path(spark, t), fmt, is_public=fmt == "csv"))
    return read_datasets(spark, table).select("id", "original_filename", "file_type", "n_rows", "n_columns", "is_public")


# every number adds a flag; no text column holds dates
REGISTERED_TABLES = _with("""
, k as (select max(id) as id from datasets)
select id, original_filename, file_type, n_rows, n_columns, is_public from datasets
union all """ + " union all ".join(
    f"select (select id from k) + {i}, '{t}.{fmt}', '{fmt}', count(*), {n}, {'true' if fmt == 'csv' else 'false'} from {t}"
    for i, (t, fmt, n) in enumerate([("customer", "csv", 5 + 3), ("part", "json", 6 + 3), ("lineitem", "parquet", 11 + 8)], 1)
))


def uploaded_orders(spark, folder):
    """An uploaded CSV from its file to the cleaned file and the row of the dataset table."""
    path, table, target = (scratch_path(spark, n) for n in ("upload", "datasets", "cleaned"))
    write_table(gappy_orders(spark, folder).orderBy("o_orderkey"), path, "csv")
    take_upload(spark, path, table, Upload(3, "orders.csv", target, "csv"))
    known = read_datasets(spark, table).select("id", "user_id", "original_filename", "n_rows", "n_columns").first()
    rows = read_csv_table(spark, target).drop(ROW_ID).withColumn("o_totalprice", F.round("o_totalprice", 6))
    return rows.withColumns({c: F.lit(known[c]) for c in known.asDict()})


def _flag(c):
    return f"coalesce({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) or {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1), false) as {c}_outlier"


def _quartiles(c):
    return f"quantile_cont({c}, 0.25) as {c}_q1, quantile_cont({c}, 0.75) as {c}_q3"


UPLOADED_ORDERS = f"""
with d as (select * replace (cast(o_custkey as double) as o_custkey) from ({GAPPY_ORDERS})),
     p as (select o_orderpriority as fill from d where o_orderpriority is not null group by 1 order by count(*) desc, 1 limit 1),
     m as (select quantile_cont(o_custkey, 0.5) as c, quantile_cont(o_totalprice, 0.5) as t, count(*) as n_rows from d),
     f as (select d.* replace (coalesce(o_custkey, m.c) as o_custkey, coalesce(o_totalprice, m.t) as o_totalprice, coalesce(o_orderpriority, p.fill) as o_orderpriority),
                  n_rows from d, m, p),
     q as (select {_quartiles('o_orderkey')}, {_quartiles('o_custkey')}, {_quartiles('o_totalprice')} from f)
select f.* replace (round(o_totalprice, 6) as o_totalprice), {_flag('o_orderkey')}, {_flag('o_custkey')}, {_flag('o_totalprice')}, day as day_date,
       1 as id, 3 as user_id, 'orders.csv' as original_filename, 11 as n_columns
from f, q"""


def checked_pages(spark, folder):
    """Page addresses, some with a data file name added, as upload names."""
    key = F.col("page_id")
    name = F.concat("url", F.when(key % 3 == 0, F.lit("/Data.CSV")).when(key % 3 == 1, F.lit("/d.json")).otherwise(F.lit("")))
    files = read(spark, folder, "pages").select("page_id", name.alias("name"), F.length("html").cast("bigint").alias("length"))
    checked = check_uploads(files, "name", "length", max_bytes=2000)
    return checked.withColumn("reason", F.coalesce("reason", F.lit("")))


CHECKED_PAGES = """
with f as (select page_id, url || case page_id % 3 when 0 then '/Data.CSV' when 1 then '/d.json' else '' end as name, length(html) as length from pages),
     e as (select *, case when contains(name, '.') then lower(string_split(name, '.')[-1]) else '' end as ext from f),
     r as (select *, case when ext not in ('csv', 'json') then 'Unsupported file type: ' || ext when length > 2000 then 'File too large' else '' end as reason from e)
select page_id, name, length, ext, reason = '' as accepted, reason from r"""


QUERIES = {
    "csv_orders": csv_orders,
    "csv_multiline": csv_multiline,
    "csv_split_notes": csv_split_notes,
    "csv_many_headers": csv_many_headers,
    "json_orders": json_orders,
    "json_mixed_list": json_mixed_list,
    "column_types": column_types,
    "described_tables": described_tables,
    "typed_orders": typed_orders,
    "event_documents": event_documents,
    "document_files": document_files,
    "named_dates": named_dates,
    "registered_tables": registered_tables,
    "uploaded_orders": uploaded_orders,
    "checked_pages": checked_pages,
}

SQL = {
    "csv_orders": CSV_ORDERS,
    "csv_multiline": CSV_MULTILINE,
    "csv_split_notes": CSV_SPLIT_NOTES,
    "csv_many_headers": CSV_MANY_HEADERS,
    "json_orders": JSON_ORDERS,
    "json_mixed_list": JSON_MIXED_LIST,
    "column_types": COLUMN_TYPES,
    "described_tables": DESCRIBED_TABLES,
    "typed_orders": TYPED_ORDERS,
    "event_documents": EVENT_DOCUMENTS,
    "document_files": DOCUMENT_FILES,
    "named_dates": NAMED_DATES,
    "registered_tables": REGISTERED_TABLES,
    "uploaded_orders": UPLOADED_ORDERS,
    "checked_pages": CHECKED_PAGES,
}
