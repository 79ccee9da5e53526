"""Queries of the profiler."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import profile as p, profile_state
from ..session import scratch_path
from .cleaning import r6
from .tables import GAPPY_LINEITEM, gappy_lineitem, read

TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


def shapes(spark, folder):
    """Rows and columns of every table."""
    parts = [p.table_shape(read(spark, folder, t)).withColumn("name", F.lit(t)) for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


SHAPES = " union all ".join(f"select '{t}' as name, count(*) as n_rows, {n} as n_columns from {t}" for t, n in TABLES.items())

# --- numbers and times ------------------------------------------------------------------------


def numeric_columns(spark, folder):
    lines = gappy_lineitem(spark, folder).withColumn("even", F.col("l_linenumber") % 2 == 0)
    summary = p.numeric_summary(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "even"])
    return r6(summary, "min", "max", "mean", "median", "std").withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


def _numeric(c, value=None, source="d"):
    v = value or c
    return (
        f"select '{c}' as \"column\", cast(min({v}) as double) as min, cast(max({v}) as double) as max, round(avg({v}), 4) as mean, "
        f"round(quantile_cont(cast({v} as double), 0.5), 6) as median, round(stddev_samp({v}), 4) as std from {source}"
    )


NUMERIC_COLUMNS = f"with d as ({GAPPY_LINEITEM}) " + " union all ".join(
    [_numeric(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")]
    + [_numeric("even", "case when l_linenumber % 2 = 0 then 1 else 0 end")]
)

STAMPS = [("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")]


def time_columns(spark, folder):
    parts = [p.datetime_summary(read(spark, folder, t).select(c)) for t, c in STAMPS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _iso(v):
    return f"case when strftime({v}, '%f') = '000000' then strftime({v}, '%Y-%m-%dT%H:%M:%S') else strftime({v}, '%Y-%m-%dT%H:%M:%S.%f') end"


TIME_COLUMNS = " union all ".join(
    f"select '{c}' as \"column\", {_iso(f'min({c})')} as first, {_iso(f'max({c})')} as last from {t}" for t, c in STAMPS
)

# --- text -------------------------------------------------------------------------------------

TEXTS = {
    "documents": ["text", "lang", "source"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "part": ["p_name", "p_brand", "p_type"],
    "conversations": ["role", "text"],
    "customer": ["c_name", "c_mktsegment"],
}
KEYS = {"documents": ["doc_id"], "orders": ["o_orderkey"], "part": ["p_partkey"], "conversations": ["conv_id", "turn"], "customer": ["c_custkey"]}


def _per_table(spark, folder, tables, job):
    parts = [job(read(spark, folder, t), t).withColumn("table_name", F.lit(t)) for t in tables]
    return reduce(lambda a, b: a.unionByName(b), parts)


def distinct_texts(spark, folder):
    return _per_table(spark, folder, TEXTS, lambda df, t: p.distinct_counts(df, TEXTS[t]))


DISTINCT_TEXTS = " union all ".join(
    f"select '{t}' as table_name, '{c}' as \"column\", count(distinct {c}) as unique_values from {t}" for t, cs in TEXTS.items() for c in cs
)


def frequent_texts(spark, folder):
    """Five most frequent values of the columns with fewer than ten."""
    return _per_table(spark, folder, TEXTS, lambda df, t: p.top_values(df, columns=TEXTS[t]))


def _frequent(t, c):
    return (
        f"select '{t}' as table_name, '{c}' as \"column\", {c} as value, count(*) as n, "
        f"cast(row_number() over (order by count(*) desc, {c}) as integer) as place from {t} where {c} is not null "
        f"and (select count(distinct {c}) from {t}) < 10 group by {c} qualify place <= 5"
    )


FREQUENT_TEXTS = " union all ".join(f"({_frequent(t, c)})" for t, cs in TEXTS.items() for c in cs)


def first_texts(spark, folder):
    """First three distinct values in row order of the columns with ten or more, and of a column without values."""

    def job(df, t):
        table = df.withColumn("nothing", F.lit(None).cast("string"))
        found = p.example_values(table, order_by=KEYS[t], columns=[*TEXTS[t], "nothing"])
        return found.select("column", F.to_json("example_values").alias("example_values"))

    return _per_table(spark, folder, KEYS, job)


def _examples(t, c):
    return f"""
    select '{t}' as table_name, '{c}' as "column", cast(to_json(list(v order by seen)) as varchar) as example_values from (
        select {c} as v, min(({", ".join(KEYS[t])})) as seen from {t} where {c} is not null group by {c} order by seen limit 3)
    where (select count(distinct {c}) from {t}) >= 10 having count(*) > 0"""


FIRST_TEXTS = " union all ".join(
    [_examples(t, c) for t in KEYS for c in TEXTS[t]]
    + [f"select '{t}' as table_name, 'nothing' as \"column\", '[]' as example_values" for t in KEYS]
)

# --- whole profiles ---------------------------------------------------------------------------

PROFILED = {
    "o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object", "o_totalprice": "float64",
    "o_orderdate": "datetime", "o_orderpriority": "object", "is_open": "bool", "clerk": "object",
}


def _profiled_orders(spark, folder):
    return read(spark, folder, "orders").select(
        "*", (F.col("o_orderstatus") == "O").alias("is_open"), F.concat(F.lit("clerk "), F.col("o_custkey") % 100).alias("clerk")
    )


def order_profile(spark, folder):
    profile = p.profile_table(_profiled_orders(spark, folder), order_by="o_orderkey")
    counted = F.transform(F.map_entries("top_values"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return profile.select(
        "position", "name", "type",
        *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "std")],
        F.coalesce("first", F.lit("")).alias("first"),
        F.coalesce("last", F.lit("")).alias("last"),
        F.coalesce("unique_values", F.lit(-1)).alias("unique_values"),
        F.coalesce(F.array_join(counted, "; "), F.lit("")).alias("top_values"),
        F.coalesce(F.array_join("example_values", "; "), F.lit("")).alias("example_values"),
    )


def _profile_row(i, name, kind):
    v = f"cast({name} as integer)" if kind == "bool" else name
    number = [f"cast(min({v}) as double)", f"cast(max({v}) as double)", f"round(avg({v}), 4)", f"round(quantile_cont(cast({v} as double), 0.5), 4)", f"round(stddev_samp({v}), 4)"]
    fields = number if kind in ("int64", "float64", "bool") else ["cast(null as double)"] * 5
    first, last = (f"min({name})", f"max({name})") if kind == "datetime" else (None, None)
    text = [f"coalesce({_iso(first)}, '')", f"coalesce({_iso(last)}, '')"] if first else ["''", "''"]
    tail = ["-1", "''", "''"]
    if kind == "object":
        count = f"(select count(distinct {name}) from d)"
        top = f"(select string_agg(v || '=' || n, '; ' order by n desc, v) from (select {name} as v, count(*) as n from d group by 1 order by n desc, v limit 5))"
        examples = f"(select string_agg(v, '; ' order by seen) from (select {name} as v, min(o_orderkey) as seen from d group by 1 order by seen limit 3))"
        tail = [count, f"case when {count} < 10 then {top} else '' end", f"case when {count} < 10 then '' else {examples} end"]
    names = ["min", "max", "mean", "median", "std", "first", "last", "unique_values", "top_values", "example_values"]
    listed = ", ".join(f"{v} as {n}" for v, n in zip(fields + text + tail, names))
    source = "(select 1)" if kind == "object" else "d"
    return f"select {i} as position, '{name}' as name, '{kind}' as type, {listed} from {source}"


ORDER_PROFILE = "with d as (select *, o_orderstatus = 'O' as is_open, 'clerk ' || o_custkey % 100 as clerk from orders) " + " union all ".join(
    _profile_row(i, n, k) for i, (n, k) in enumerate(PROFILED.items())
)


def order_document(spark, folder):
    """The profile as one JSON document."""
    return p.profile_json(_profiled_orders(spark, folder), "orders.csv", "csv", order_by="o_orderkey", decimals=2)


def _member(i, name, kind):
    v = f"cast({name} as integer)" if kind == "bool" else name
    fixed = lambda e: f"cast(cast(round({e}, 2) as decimal(38, 2)) as varchar)"
    start = f"""'"{name}":{{"type":"{kind}","name":"{name}"'"""
    if kind in ("int64", "float64", "bool"):
        values = {"min": f"min({v})", "max": f"max({v})", "mean": f"avg({v})", "median": f"quantile_cont(cast({v} as double), 0.5)", "std": f"stddev_samp({v})"}
        body = " || ".join(f"""',"{n}":' || {fixed(e)}""" for n, e in values.items())
        return f"select {i} as position, {start} || {body} || '}}' as member from d"
    if kind == "datetime":
        return f"""select {i} as position, {start} || ',"min":"' || {_iso(f'min({name})')} || '","max":"' || {_iso(f'max({name})')} || '"}}' as member from d"""
    count = f"(select count(distinct {name}) from d)"
    top = f"""(select string_agg('"' || v || '":' || n, ',' order by n desc, v) from (select {name} as v, count(*) as n from d group by 1 order by n desc, v limit 5))"""
    examples = f"""(select string_agg('"' || v || '"', ',' order by seen) from (select {name} as v, min(o_orderkey) as seen from d group by 1 order by seen limit 3))"""
    shown = f"""case when {count} < 10 then '"top_values":{{' || {top} || '}}' else '"example_values":[' || {examples} || ']' end"""
    return f"""select {i} as position, {start} || ',"unique_values":' || {count} || ',' || {shown} || '}}' as member"""


ORDER_DOCUMENT = (
    "with d as (select *, o_orderstatus = 'O' as is_open, 'clerk ' || o_custkey % 100 as clerk from orders), m as ("
    + " union all ".join(_member(i, n, k) for i, (n, k) in enumerate(PROFILED.items()))
    + """) select '{"original_filename":"orders.csv","file_type":"csv","n_rows":' || (select count(*) from d) || ',"n_columns":8,"column_info":{'
       || string_agg(member, ',' order by position) || '}}' as document from m"""
)


# --- first rows -------------------------------------------------------------------------------

SHOWN = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def first_orders(spark, folder):
    return p.preview(read(spark, folder, "orders").select(SHOWN), 10, "o_orderkey")


FIRST_ORDERS = f"select {', '.join(SHOWN)} from orders order by o_orderkey limit 10"


def orders_as_csv(spark, folder):
    return p.excerpt(read(spark, folder, "orders").select(SHOWN), "csv", 2000, "o_orderkey")


ORDERS_AS_CSV = f"""
with t as (select '{','.join(SHOWN)}' || chr(10) || string_agg({" || ',' || ".join(SHOWN)}, chr(10) order by o_orderkey) || chr(10) as text
           from orders)
select case when length(text) > 2000 then substring(text, 1, 2000) || '...' else text end as excerpt from t"""


def orders_as_json(spark, folder):
    return p.excerpt(read(spark, folder, "orders").select(SHOWN), "json", 2000, "o_orderkey")


ORDERS_AS_JSON = """
with t as (select '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus
                  || '","o_totalprice":' || o_totalprice || ',"o_orderpriority":"' || o_orderpriority || '"}', ',' order by o_orderkey) || ']' as text
           from orders)
select case when length(text) > 2000 then substring(text, 1, 2000) || '...' else text end as excerpt from t"""


LOADS = 3
PROBABILITIES = [0.01, 0.25, 0.5, 0.75, 0.99]


def profile_by_load(spark, folder):
    """Line items that arrive in loads, one of them twice: each is read once for its state, and the merged state is the profile of all.

    Estimates are shown by whether they keep to their bounds against the exact ranks of the whole table.
    """
    lines, path = gappy_lineitem(spark, folder), scratch_path(spark, "states")
    for load in [*range(LOADS), 0]:
        profile_state.add_load(lines.where(F.col("l_orderkey") % LOADS == load), path, load)
    merged = profile_state.merged_profile(spark.read.schema(f"{profile_state.STATE}, load int").parquet(path), PROBABILITIES)
    found = profile_state.known_values(merged, PROBABILITIES)
    errors = profile_state.rank_errors(lines, found).groupBy("column").agg(F.max("error").alias("error"))
    texts = [c for c, kind in lines.dtypes if kind == "string"]
    exact = lines.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("exact")) for c in texts]).alias("rows")).select(F.inline("rows"))
    shown = merged.join(errors, "column", "left").join(exact, "column", "left")
    near = F.abs(F.col("unique_values") - F.col("exact")) <= 0.06 * F.col("exact")
    return r6(shown, "min", "max").select(
        "position", "column", "type", "n_rows", "n", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        profile_state.within(F.col("error")).alias("ranks_hold"), F.coalesce(near, F.lit(True)).alias("distinct_holds"),
    )


def _load_row(place, c, kind):
    stats = ", ".join(f"{x} as {n}" for n, x in (
        ("min", f"round(cast(min({c}) as double), 6)"), ("max", f"round(cast(max({c}) as double), 6)"), ("mean", f"round(avg({c}), 4)"), ("std", f"round(stddev_samp({c}), 4)"),
    )) if kind != "object" else ", ".join(f"cast(null as double) as {n}" for n in ("min", "max", "mean", "std"))
    return f"select {place} as position, '{c}' as \"column\", '{kind}' as type, count(*) as n_rows, count({c}) as n, {stats}, true as ranks_hold, true as distinct_holds from d"


_LOADED = [
    ("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"), ("l_linenumber", "int64"), ("l_extendedprice", "float64"), ("l_discount", "float64"),
    ("l_quantity", "float64"), ("l_returnflag", "object"), ("shipped", "object"),
]
PROFILE_BY_LOAD = f"with d as ({GAPPY_LINEITEM}) " + " union all ".join(_load_row(i, c, kind) for i, (c, kind) in enumerate(_LOADED))


QUERIES = {
    "profile_by_load": profile_by_load,
    "shapes": shapes,
    "numeric_columns": numeric_columns,
    "time_columns": time_columns,
    "distinct_texts": distinct_texts,
    "frequent_texts": frequent_texts,
    "first_texts": first_texts,
    "order_profile": order_profile,
    "order_document": order_document,
    "first_orders": first_orders,
    "orders_as_csv": orders_as_csv,
    "orders_as_json": orders_as_json,
}

SQL = {
    "profile_by_load": PROFILE_BY_LOAD,
    "shapes": SHAPES,
    "numeric_columns": NUMERIC_COLUMNS,
    "time_columns": TIME_COLUMNS,
    "distinct_texts": DISTINCT_TEXTS,
    "frequent_texts": FREQUENT_TEXTS,
    "first_texts": FIRST_TEXTS,
    "order_profile": ORDER_PROFILE,
    "order_document": ORDER_DOCUMENT,
    "first_orders": FIRST_ORDERS,
    "orders_as_csv": ORDERS_AS_CSV,
    "orders_as_json": ORDERS_AS_JSON,
}
