"""Queries of the cleaner."""

from pyspark.sql import functions as F

from ..functions.kinds import number
from ..operators.clean import clean, fit_clean
from ..operators.clean_by import clean_by
from ..operators.datecols import date_gate, detect_date_format, fit_formats, parse_dates
from ..operators.impute import impute_median, impute_mode
from ..operators.outliers import iqr_bounds, tag_outliers
from ..operators.quantiles import exact_quantiles
from .tables import GAPPY_EVENTS, GAPPY_LINEITEM, LINEITEM_ORDER, gappy_events, gappy_lineitem, read, text

# Patterns that write the twelve formats zero-padded, and their counterparts in SQL.
WRITTEN = [
    "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MMM dd, yyyy", "dd MMM yyyy",
    "MMMM dd, yyyy", "dd MMMM yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "yyyy.MM.dd", "dd.MM.yyyy",
]
SQL_FORMATS = [
    "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%b %d, %Y", "%d %b %Y",
    "%B %d, %Y", "%d %B %Y", "%m-%d-%Y", "%d-%m-%Y", "%Y.%m.%d", "%d.%m.%Y",
]


# The patterns that the formats are reported under, written out here so that the SQL checks them too.
PATTERNS = [
    "yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "MMM d, yyyy", "d MMM yyyy",
    "MMMM d, yyyy", "d MMMM yyyy", "M-d-yyyy", "d-M-yyyy", "yyyy.M.d", "d.M.yyyy",
]


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- imputation -------------------------------------------------------------------------------


def median_fill(spark, folder):
    events = gappy_events(spark, folder).select("event_id", "value")
    return r6(impute_median(events, ["value"]), "value")


MEDIAN_FILL = f"""
with d as ({GAPPY_EVENTS})
select event_id, round(coalesce(value, (select quantile_cont(value, 0.5) from d)), 6) as value from d"""


def mode_fill(spark, folder):
    events = gappy_events(spark, folder).select("event_id", "event_type")
    return impute_mode(events, ["event_type"])


MODE_FILL = f"""
with d as ({GAPPY_EVENTS}),
     m as (select event_type from d where event_type is not null group by event_type order by count(*) desc, event_type limit 1)
select event_id, coalesce(event_type, (select event_type from m)) as event_type from d"""

# --- outliers ---------------------------------------------------------------------------------

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def outlier_bounds(spark, folder):
    bounds = iqr_bounds(read(spark, folder, "lineitem"), MEASURES)
    return r6(bounds, "q1", "q3", "lower", "upper")


OUTLIER_BOUNDS = "with q as (" + " union all ".join(
    f"select '{c}' as \"column\", quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from lineitem" for c in MEASURES
) + """)
select "column", round(q1, 6) as q1, round(q3, 6) as q3,
       round(q1 - 1.5 * (q3 - q1), 6) as lower, round(q3 + 1.5 * (q3 - q1), 6) as upper from q"""


def outlier_flags(spark, folder):
    events = gappy_events(spark, folder).select("event_id", "value")
    return tag_outliers(events, ["value"])


OUTLIER_FLAGS = f"""
with d as ({GAPPY_EVENTS}),
     q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from d)
select event_id, value, coalesce(value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1), false) as value_outlier
from d, q"""

# --- dates ------------------------------------------------------------------------------------


def written_dates(spark, folder):
    orders = read(spark, folder, "orders")
    texts = [F.when(F.col("o_orderkey") % 10 == 7, "n/a").otherwise(text(p, "o_orderdate")).alias(f"d{i}") for i, p in enumerate(WRITTEN)]
    return orders.select("o_orderkey", *texts)


WRITTEN_DATES = "select o_orderkey, " + ", ".join(
    f"case when o_orderkey % 10 = 7 then 'n/a' else strftime(o_orderdate, '{f}') end as d{i}" for i, f in enumerate(SQL_FORMATS)
) + " from orders"


def date_formats(spark, folder):
    return detect_date_format(written_dates(spark, folder), order_by="o_orderkey")


_FIRST_MATCH = "case " + " ".join(
    f"when try_strptime(v, '{f}') is not null then '{p}'" for f, p in zip(SQL_FORMATS, PATTERNS)
) + " else 'any' end"
DATE_FORMATS_SQL = f"with d as ({WRITTEN_DATES}), s as (" + " union all ".join(
    f"select 'd{i}' as \"column\", arg_min(d{i}, o_orderkey) as v from d" for i in range(12)
) + f") select \"column\", {_FIRST_MATCH} as format from s"


def parsed_dates(spark, folder):
    written = written_dates(spark, folder)
    parsed = parse_dates(written, {f"d{i}": p for i, p in enumerate(PATTERNS)})
    return parsed.select("o_orderkey", *[f"d{i}_date" for i in range(12)])


PARSED_DATES = f"with d as ({WRITTEN_DATES}) select o_orderkey, " + ", ".join(
    f"strftime(try_strptime(d{i}, '{f}'), '%Y-%m-%d') as d{i}_date" for i, f in enumerate(SQL_FORMATS)
) + " from d"


def doubtful_dates(spark, folder):
    """A column of mostly dates, one of exactly half, one whose sample hides the day-first order."""
    key, orders = F.col("o_orderkey"), read(spark, folder, "orders")
    return orders.select(
        "o_orderkey",
        F.when(key % 10 == 7, "n/a").otherwise(text("yyyy.MM.dd", "o_orderdate")).alias("most"),
        F.when(key % 2 == 1, "n/a").otherwise(text("yyyy.MM.dd", "o_orderdate")).alias("half"),
        text("dd/MM/yyyy", "o_orderdate").alias("ambiguous"),
    )


def gated_dates(spark, folder):
    dates = doubtful_dates(spark, folder)
    formats = fit_formats(dates, ["most", "half", "ambiguous"], "o_orderkey")
    kept = date_gate(dates, formats)
    derived = [c for c in kept.columns if c.endswith("_date")]
    return kept.unpivot("o_orderkey", derived, "column", "day")


def _gated(column, fmt):
    return (
        f"select o_orderkey, '{column}_date' as \"column\", strftime(try_strptime({column}, '{fmt}'), '%Y-%m-%d') as day from d "
        f"where (select avg(case when try_strptime({column}, '{fmt}') is null then 0 else 1 end) from d) > 0.5"
    )


def _ambiguous():
    # month-first if the first date allows it, else day-first
    fmt = "(select case when try_strptime(arg_min(ambiguous, o_orderkey), '%m/%d/%Y') is null then '%d/%m/%Y' else '%m/%d/%Y' end from d)"
    tried = f"case when {fmt} = '%m/%d/%Y' then try_strptime(ambiguous, '%m/%d/%Y') else try_strptime(ambiguous, '%d/%m/%Y') end"
    return (
        f"select o_orderkey, 'ambiguous_date' as \"column\", strftime({tried}, '%Y-%m-%d') as day from d "
        f"where (select avg(case when {tried} is null then 0 else 1 end) from d) > 0.5"
    )


GATED_DATES = f"""
with d as (select o_orderkey, case when o_orderkey % 10 = 7 then 'n/a' else strftime(o_orderdate, '%Y.%m.%d') end as most,
                  case when o_orderkey % 2 = 1 then 'n/a' else strftime(o_orderdate, '%Y.%m.%d') end as half,
                  strftime(o_orderdate, '%d/%m/%Y') as ambiguous from orders)
{_gated('most', '%Y.%m.%d')} union all {_gated('half', '%Y.%m.%d')} union all {_ambiguous()}"""

# --- the whole cleaner ------------------------------------------------------------------------


def clean_events(spark, folder):
    return r6(clean(gappy_events(spark, folder), "event_id"), "value")


def _flag(column, value=None):
    value = value or column
    return (
        f"coalesce({value} < {column}_q1 - 1.5 * ({column}_q3 - {column}_q1) "
        f"or {value} > {column}_q3 + 1.5 * ({column}_q3 - {column}_q1), false) as {column}_outlier"
    )


def _quartiles(*columns):
    return ", ".join(f"quantile_cont({c}, 0.25) as {c}_q1, quantile_cont({c}, 0.75) as {c}_q3" for c in columns)


CLEAN_EVENTS = f"""
with d as ({GAPPY_EVENTS}),
     m as (select event_type from d where event_type is not null group by event_type order by count(*) desc, event_type limit 1),
     f as (select event_id, user_id, coalesce(value, (select quantile_cont(value, 0.5) from d)) as value,
                  coalesce(event_type, (select event_type from m)) as event_type, day from d),
     q as (select {_quartiles('event_id', 'user_id', 'value')} from f)
select event_id, user_id, round(value, 6) as value, event_type, day,
       {_flag('event_id')}, {_flag('user_id')}, {_flag('value')},
       strftime(try_strptime(day, '%d.%m.%Y'), '%Y-%m-%d') as day_date
from f, q"""


def clean_lineitem(spark, folder):
    return r6(clean(gappy_lineitem(spark, folder), LINEITEM_ORDER), "l_quantity")


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity"]
CLEAN_LINEITEM = f"""
with d as ({GAPPY_LINEITEM}),
     m as (select l_returnflag from d where l_returnflag is not null group by l_returnflag order by count(*) desc, l_returnflag limit 1),
     f as (select * replace (coalesce(l_quantity, (select quantile_cont(l_quantity, 0.5) from d)) as l_quantity,
                             coalesce(l_returnflag, (select l_returnflag from m)) as l_returnflag) from d),
     q as (select {_quartiles(*_LINE_NUMBERS)} from f)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, round(l_quantity, 6) as l_quantity,
       l_returnflag, shipped, {', '.join(_flag(c) for c in _LINE_NUMBERS)},
       strftime(try_strptime(shipped, '%Y/%m/%d'), '%Y-%m-%d') as shipped_date
from f, q"""


def clean_by_supplier(spark, folder):
    """Line items per supplier, with numbers, text and dates of its own."""
    cleaned = clean_by(gappy_lineitem(spark, folder), "l_suppkey", order_by="l_orderkey")
    return _shown(cleaned)


def clean_by_salted(spark, folder):
    """The same per return flag, with limits that make every group a large one: ranked by many tasks, statistics joined by a shuffle."""
    lines = gappy_lineitem(spark, folder)
    n_rows = lines.count()
    cleaned = clean_by(lines, "l_linenumber", order_by=LINEITEM_ORDER, group_rows=n_rows // 20, broadcast_bytes=10_000, salt_rows=n_rows // 50)
    return _shown(cleaned)


def _shown(cleaned):
    return r6(cleaned, "l_quantity", "l_extendedprice", "l_discount").withColumn("l_returnflag_date", F.coalesce("l_returnflag_date", F.lit("")))


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity"]


def _by(key):
    numbers = [c for c in _LINE_COLUMNS if c != key]
    whole = [c for c in _LINE_COLUMNS if c not in (key, "l_extendedprice", "l_discount", "l_quantity")]
    return f"""
with d as ({GAPPY_LINEITEM}),
     c as (select {key}, l_returnflag, count(*) as n from d where l_returnflag is not null group by all),
     m as (select {key}, l_returnflag as fill from c qualify row_number() over (partition by {key} order by n desc, l_returnflag) = 1),
     k as (select {key}, quantile_cont(l_quantity, 0.5) as median from d group by {key}),
     f as (select d.* replace (coalesce(l_quantity, median) as l_quantity, coalesce(l_returnflag, fill) as l_returnflag)
           from d join k using ({key}) join m using ({key})),
     q as (select {key}, {_quartiles(*numbers)} from f group by {key}),
     s as (select {key}, avg(case when try_strptime(shipped, '%Y/%m/%d') is null then 0 else 1 end) > 0.5 as dated from d group by {key})
select {key}, {', '.join(f'cast({c} as double) as {c}' for c in whole)}, round(l_extendedprice, 6) as l_extendedprice,
       round(l_discount, 6) as l_discount, round(l_quantity, 6) as l_quantity, l_returnflag, shipped,
       {', '.join(_flag(c) for c in numbers)},
       case when dated then strftime(try_strptime(shipped, '%Y/%m/%d'), '%Y-%m-%d') end as shipped_date, '' as l_returnflag_date
from f join q using ({key}) join s using ({key})"""


CLEAN_BY_SUPPLIER = _by("l_suppkey")
CLEAN_BY_SALTED = _by("l_linenumber")


def _tenants(events):
    """A third of all events belongs to one tenant."""
    return events.withColumn("tenant", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id"))).drop("user_id")


def clean_by_hot_tenant(spark, folder):
    """A group of a third of all rows, which exceeds the limit given here and is ranked by many tasks; texts and dates included."""
    events = _tenants(gappy_events(spark, folder))
    n_rows = events.count()
    cleaned = clean_by(events, "tenant", order_by="event_id", group_rows=max(n_rows // 8, 1))
    return r6(cleaned, "value").withColumns({c: F.coalesce(c, F.lit("")) for c in ("event_type_date", "day_date")})


CLEAN_BY_HOT_TENANT = f"""
with d as (select * exclude (user_id), case when event_id % 3 = 0 then 0 else user_id end as tenant from ({GAPPY_EVENTS})),
     k as (select tenant, quantile_cont(value, 0.5) as median from d group by tenant),
     c as (select tenant, event_type, count(*) as n from d where event_type is not null group by all),
     m as (select tenant, event_type as fill from c qualify row_number() over (partition by tenant order by n desc, event_type) = 1),
     f as (select d.* replace (coalesce(value, median) as value, coalesce(event_type, fill, 'Unknown') as event_type)
           from d join k using (tenant) left join m using (tenant)),
     q as (select tenant, {_quartiles('event_id', 'value')} from f group by tenant),
     s as (select tenant, avg(case when try_strptime(day, '%d.%m.%Y') is null then 0 else 1 end) > 0.5 as dated from d group by tenant)
select cast(event_id as double) as event_id, tenant, round(value, 6) as value, event_type, day, {_flag('event_id')}, {_flag('value')}, '' as event_type_date,
       coalesce(case when dated then strftime(try_strptime(day, '%d.%m.%Y'), '%Y-%m-%d') end, '') as day_date
from f join q using (tenant) join s using (tenant)"""


def exact_bounds_narrowed(spark, folder):
    """Quantiles found between narrowed edges, whatever the size of the table."""
    lines = gappy_lineitem(spark, folder)
    names = ["l_quantity", "l_extendedprice", "l_partkey", "l_discount"]
    n_rows = lines.count()
    found = exact_quantiles(lines, {c: number(lines, c) for c in names}, _NARROWED, direct_rows=n_rows // 200)
    rows = [(c, p, q) for c, values in found.items() for p, q in zip(_NARROWED, values)]
    return r6(spark.createDataFrame(rows, "column string, p double, q double"), "q")


_NARROWED = [0.001, 0.25, 0.5, 0.75, 0.999]
EXACT_BOUNDS_NARROWED = f"with d as ({GAPPY_LINEITEM}) " + " union all ".join(
    f"select '{c}' as \"column\", cast({p} as double) as p, round(quantile_cont(cast({c} as double), {p}), 6) as q from d"
    for c in ("l_quantity", "l_extendedprice", "l_partkey", "l_discount")
    for p in _NARROWED
)


def model_on_later_events(spark, folder):
    """A model fitted on the events without gaps, applied to the others."""
    events, whole = gappy_events(spark, folder), (F.col("event_id") % 7 != 0) & (F.col("event_id") % 5 != 0)
    model = fit_clean(events.where(whole), "event_id", reusable=True)
    return r6(model.transform(events.where(~whole)), "value")


MODEL_ON_LATER_EVENTS = f"""
with d as ({GAPPY_EVENTS}), t as (select * from d where event_id % 7 <> 0 and event_id % 5 <> 0),
     m as (select event_type as fill from t group by 1 order by count(*) desc, 1 limit 1),
     q as (select quantile_cont(value, 0.5) as median, {_quartiles('event_id', 'user_id', 'value')} from t),
     f as (select d.* replace (coalesce(value, median) as value, coalesce(event_type, fill) as event_type) from d, m, q
           where event_id % 7 = 0 or event_id % 5 = 0)
select event_id, user_id, round(value, 6) as value, event_type, day, {_flag('event_id')}, {_flag('user_id')}, {_flag('value')},
       strftime(try_strptime(day, '%d.%m.%Y'), '%Y-%m-%d') as day_date
from f, q"""


def flagged_events(spark, folder):
    """Events per type and outlier flag after filling the gaps."""
    value = F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")
    events = read(spark, folder, "events").select("event_id", value, "event_type")
    flagged = tag_outliers(impute_median(events, ["value"]), ["value"])
    return flagged.groupBy("event_type", "value_outlier").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


FLAGGED_EVENTS = f"""
with d as (select event_id, g.value, e.event_type from ({GAPPY_EVENTS}) g join events e using (event_id)),
     f as (select event_id, event_type, coalesce(value, (select quantile_cont(value, 0.5) from d)) as value from d),
     q as (select {_quartiles('value')} from f),
     t as (select event_type, value, {_flag('value')} from f, q)
select event_type, value_outlier, count(*) as n, round(avg(value), 6) as mean_value from t group by event_type, value_outlier"""


QUERIES = {
    "median_fill": median_fill,
    "mode_fill": mode_fill,
    "outlier_bounds": outlier_bounds,
    "outlier_flags": outlier_flags,
    "exact_bounds_narrowed": exact_bounds_narrowed,
    "model_on_later_events": model_on_later_events,
    "flagged_events": flagged_events,
    "date_formats": date_formats,
    "parsed_dates": parsed_dates,
    "gated_dates": gated_dates,
    "clean_events": clean_events,
    "clean_lineitem": clean_lineitem,
    "clean_by_supplier": clean_by_supplier,
    "clean_by_salted": clean_by_salted,
    "clean_by_hot_tenant": clean_by_hot_tenant,
}

SQL = {
    "median_fill": MEDIAN_FILL,
    "mode_fill": MODE_FILL,
    "outlier_bounds": OUTLIER_BOUNDS,
    "outlier_flags": OUTLIER_FLAGS,
    "exact_bounds_narrowed": EXACT_BOUNDS_NARROWED,
    "model_on_later_events": MODEL_ON_LATER_EVENTS,
    "flagged_events": FLAGGED_EVENTS,
    "date_formats": DATE_FORMATS_SQL,
    "parsed_dates": PARSED_DATES,
    "gated_dates": GATED_DATES,
    "clean_events": CLEAN_EVENTS,
    "clean_lineitem": CLEAN_LINEITEM,
    "clean_by_supplier": CLEAN_BY_SUPPLIER,
    "clean_by_salted": CLEAN_BY_SALTED,
    "clean_by_hot_tenant": CLEAN_BY_HOT_TENANT,
}
