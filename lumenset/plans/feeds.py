"""Queries of the dashboard feeds, the quality report and the page jobs."""

from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from ..operators import cube as cb, feeds as f
from ..operators.markup import audit_html, repair_html, strip_code_fence
from ..operators.quality import duplicate_rows, quality_report
from ..operators.ranks import rank_correlations
from ..session import scratch_path
from .tables import GAPPY_LINEITEM, gappy_lineitem, read, text

# --- rows and aggregates ----------------------------------------------------------------------


def order_records(spark, folder):
    orders = read(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return f.records_json(orders)


ORDER_RECORDS = """
select '{"o_orderkey":' || o_orderkey || ',"o_totalprice":' || case when o_orderkey % 7 = 0 then 'null' else cast(o_totalprice as varchar) end
       || ',"o_orderpriority":' || case when o_orderkey % 5 = 0 then 'null' else '"' || o_orderpriority || '"' end || '}' as record
from orders"""

MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _rounded(df, *totals):
    return df.withColumns({c: F.round(c, 2) for c in totals})


def lineitem_kpis(spark, folder):
    block = f.kpis(gappy_lineitem(spark, folder), MEASURES)
    return _rounded(block, "total").withColumn("mean", F.round("mean", 4))


LINEITEM_KPIS = f"with d as ({GAPPY_LINEITEM}) " + " union all ".join(
    f"select '{c}' as measure, count({c}) as n, round(sum({c}), 2) as total, round(avg({c}), 4) as mean, min({c}) as min, max({c}) as max from d"
    for c in MEASURES
)


def suppliers_by_revenue(spark, folder):
    lines = read(spark, folder, "lineitem").withColumn("supplier", F.col("l_suppkey").cast("string"))
    return _rounded(f.by_category(lines, "supplier", "l_extendedprice", 10), "total").withColumn("share", F.round("share", 6))


SUPPLIERS_BY_REVENUE = """
with s as (select cast(l_suppkey as varchar) as category, count(*) as n, sum(l_extendedprice) as total from lineitem group by 1),
     r as (select *, row_number() over (order by total desc, category) > 10 as is_other from s)
select case when is_other then 'Other' else category end as category, is_other, cast(sum(n) as bigint) as n,
       round(sum(total), 2) as total, round(sum(total) / (select sum(total) from s), 6) as share
from r group by 1, 2"""

GRAINS = ["day", "week", "month"]


def orders_over_time(spark, folder):
    orders = read(spark, folder, "orders")
    parts = [f.by_time(orders, "o_orderdate", g, "o_totalprice").withColumn("grain", F.lit(g)) for g in GRAINS]
    series = reduce(lambda a, b: a.unionByName(b), parts)
    # the mean from the rounded total: a mean of few amounts often ends in a 5 that engines round differently
    rounded = _rounded(series, "total").withColumn("mean", F.col("total") / F.col("n"))
    return rounded.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


ORDERS_OVER_TIME = " union all ".join(
    f"select '{g}' as grain, strftime(date_trunc('{g}', o_orderdate), '%Y-%m-%d') as bucket, count(*) as n, "
    "round(sum(o_totalprice), 2) as total, round(sum(o_totalprice), 2) / count(*) as mean from orders group by 1, 2"
    for g in GRAINS
)


def segments_by_priority(spark, folder):
    customers = read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = read(spark, folder, "orders").join(customers, "o_custkey")
    return _rounded(f.by_two(orders, "c_mktsegment", "o_orderpriority", "o_totalprice"), "total")


SEGMENTS_BY_PRIORITY = """
select c_mktsegment as "row", o_orderpriority as "column", count(*) as n, round(sum(o_totalprice), 2) as total
from orders join customer on c_custkey = o_custkey group by 1, 2"""


def order_points(spark, folder):
    orders = read(spark, folder, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")))
    return f.scatter(orders, "day", "o_totalprice", "o_orderkey", 500)


ORDER_POINTS = """
select o_orderkey as key, date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as x, o_totalprice as y
from orders order by md5(cast(o_orderkey as varchar)), o_orderkey limit 500"""


def filtered_orders(spark, folder):
    orders = read(spark, folder, "orders")
    chosen = f.apply_filters(
        orders,
        isin={"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": ["O", "F"]},
        between={"o_totalprice": (50_000.0, 300_000.0), "o_custkey": (10, None), "o_orderdate": (datetime(1993, 5, 1), datetime(1997, 12, 31))},
    )
    return _rounded(f.kpis(chosen, ["o_totalprice"]), "total", "mean")


FILTERED_ORDERS = """
select 'o_totalprice' as measure, count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 2) as mean,
       min(o_totalprice) as min, max(o_totalprice) as max
from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus in ('O', 'F')
  and o_totalprice between 50000 and 300000 and o_custkey >= 10 and o_orderdate between timestamp '1993-05-01' and timestamp '1997-12-31'"""

CUBE_DIMENSIONS = ["o_orderstatus", "o_orderpriority", "year"]
CHOSEN = {"o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"]}
MONTHS = {"month": (datetime(1993, 5, 1), datetime(1997, 12, 1))}


def feeds_from_cube(spark, folder):
    """KPIs, categories, months and a heatmap of orders under filters, all from one cube; the rows are read once, when it is built."""
    orders = read(spark, folder, "orders").withColumn("year", F.year("o_orderdate").cast("string"))
    orders = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    cube = cb.build_cube(orders, CUBE_DIMENSIONS, ["o_totalprice"], scratch_path(spark, "cube"), {"month": ("o_orderdate", "month")})
    blocks = {
        "kpis": (cb.kpis_of(cube, CHOSEN, MONTHS), F.lit("o_totalprice"), F.lit("")),
        "categories": (cb.by_category_of(cube, "year", "o_totalprice", 3, CHOSEN), F.col("category"), F.lit("")),
        "months": (cb.by_time_of(cube, "month", "o_totalprice", CHOSEN, MONTHS), F.date_format("bucket", "yyyy-MM-dd"), F.lit("")),
        "heatmap": (cb.by_two_of(cube, "o_orderstatus", "o_orderpriority", "o_totalprice", None, MONTHS), F.col("row"), F.col("column")),
    }
    parts = [df.select(F.lit(k).alias("block"), a.alias("first"), b.alias("second"), "n", F.round("total", 2).alias("total")) for k, (df, a, b) in blocks.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


_CHOSEN_SQL = "o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW')"
_MONTHS_SQL = "o_orderdate >= timestamp '1993-05-01' and o_orderdate < timestamp '1998-01-01'"
FEEDS_FROM_CUBE = f"""
with d as (select o_orderdate, o_orderstatus, o_orderpriority, case when o_orderkey % 7 = 0 then null else o_totalprice end as price from orders),
     y as (select cast(year(o_orderdate) as varchar) as category, count(*) as n, sum(price) as total from d where {_CHOSEN_SQL} group by 1),
     r as (select *, row_number() over (order by total desc, category) > 3 as is_other from y)
select 'kpis' as block, 'o_totalprice' as first, '' as second, count(price) as n, round(sum(price), 2) as total from d where {_CHOSEN_SQL} and {_MONTHS_SQL}
union all select 'categories', case when is_other then 'Other' else category end, '', cast(sum(n) as bigint), round(sum(total), 2) from r group by 2, is_other
union all select 'months', strftime(date_trunc('month', o_orderdate), '%Y-%m-%d'), '', count(*), round(sum(price), 2) from d
          where {_CHOSEN_SQL} and {_MONTHS_SQL} group by 2
union all select 'heatmap', o_orderstatus, o_orderpriority, count(*), round(sum(price), 2) from d where {_MONTHS_SQL} group by 2, 3"""

PAIRED = ["l_extendedprice", "l_discount", "l_quantity", "l_linenumber", "fixed"]


def lineitem_correlations(spark, folder):
    lines = gappy_lineitem(spark, folder).withColumn("fixed", F.lit(1.0))
    return f.correlations(lines, PAIRED).withColumn("r", F.round(F.col("r"), 6))


LINEITEM_CORRELATIONS = f"with d as (select *, cast(1 as double) as fixed from ({GAPPY_LINEITEM})) " + " union all ".join(
    f"select '{a}' as x, '{b}' as y, count(*) as n, "
    + ("cast(null as double)" if "fixed" in (a, b) else f"round(corr(cast({a} as double), cast({b} as double)), 6)")
    + f" as r from d where {a} is not null and {b} is not null"
    for i, a in enumerate(PAIRED)
    for b in PAIRED[i + 1 :]
)

RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "fixed"]


def lineitem_rank_correlations(spark, folder):
    """Ties everywhere: a few discounts, quantities with gaps, a constant."""
    lines = gappy_lineitem(spark, folder).withColumn("fixed", F.lit(1.0))
    return rank_correlations(lines, RANKED).withColumn("r", F.round(F.col("r"), 6))


LINEITEM_RANK_CORRELATIONS = f"with d as (select *, cast(1 as double) as fixed from ({GAPPY_LINEITEM})), k as (select " + ", ".join(
    f"case when {c} is not null then rank() over (partition by {c} is null order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 end as {c}" for c in RANKED
) + " from d) " + " union all ".join(
    f"select '{a}' as x, '{b}' as y, count(*) as n, "
    + ("cast(null as double)" if "fixed" in (a, b) else f"round(corr(cast({a} as double), cast({b} as double)), 6)")
    + f" as r from k where {a} is not null and {b} is not null"
    for i, a in enumerate(RANKED)
    for b in RANKED[i + 1 :]
)

# --- data quality -----------------------------------------------------------------------------


def _doubtful(spark, folder):
    key = F.col("event_id")
    first = read(spark, folder, "events").agg(F.min("event_id")).first()[0]
    return read(spark, folder, "events").select(
        "event_id",
        "event_type",
        F.when(key % 7 != 0, F.floor("value")).alias("whole_value"),
        F.lit("web").alias("channel"),
        F.when(key % 10 == 3, "soon").otherwise(text("dd.MM.yyyy", "ts")).alias("day"),
        # names of which the first is a date, and dates of which the first is none
        F.when(key == first, "2024-01-05").otherwise(F.concat(F.lit("name of "), "event_type")).alias("name"),
        F.when((key == first) | (key % 4 == 1), "later").otherwise(text("yyyy-MM-dd", "ts")).alias("due"),
    )


DOUBTFUL = """
    select event_id, event_type, case when event_id % 7 = 0 then null else cast(floor(value) as bigint) end as whole_value, 'web' as channel,
           case when event_id % 10 = 3 then 'soon' else strftime(ts, '%d.%m.%Y') end as day,
           case when event_id = (select min(event_id) from events) then '2024-01-05' else 'name of ' || event_type end as name,
           case when event_id = (select min(event_id) from events) or event_id % 4 = 1 then 'later' else strftime(ts, '%Y-%m-%d') end as due
    from events"""


def quality_issues(spark, folder):
    judged = ["event_type", "whole_value", "channel", "day", "name", "due"]
    report = quality_report(_doubtful(spark, folder), order_by="event_id", columns=judged)
    return report.withColumn("affected_columns", F.array_join("affected_columns", ","))


QUALITY_ISSUES = f"""
with d as ({DOUBTFUL}), n as (select count(*) as n from d),
     q as (select quantile_cont(whole_value, 0.25) as q1, quantile_cont(whole_value, 0.75) as q3 from d),
     o as (select count(*) as k from d, q where whole_value < q1 - 1.5 * (q3 - q1) or whole_value > q3 + 1.5 * (q3 - q1)),
     g as (select count(*) - count(distinct (event_type, whole_value, channel, day, name, due)) as k from d)
select 'missing values' as issue_type, (count(*) - count(whole_value)) || ' of ' || count(*) || ' values are missing' as description,
       'whole_value' as affected_columns from d having count(whole_value) < count(*)
union all select 'constant column', 'all values are equal', 'channel'
union all select 'outliers', k || ' of ' || n || ' values lie outside the interquartile fences', 'whole_value' from o, n where k > 0
union all select 'unparsable dates', count(*) || ' of ' || (select n from n) || ' values do not match d.M.yyyy', 'day' from d where day = 'soon'
union all select 'unparsable dates', count(*) || ' of ' || (select n from n) || ' values are no dates', 'due' from d where due = 'later'
union all select 'duplicate rows', k || ' of ' || n || ' rows repeat another row', 'event_type,whole_value,channel,day,name,due' from g, n where k > 0"""


def repeated_texts(spark, folder):
    """Documents whose text, language and source repeat another document's."""
    documents = read(spark, folder, "documents").select("text", "lang", "source")
    repeats = duplicate_rows(documents)
    return documents.agg(F.count("*").alias("n_rows")).withColumn("repeats", F.lit(repeats))


REPEATED_TEXTS = """
select count(*) as n_rows, count(*) - (select count(*) from (select distinct text, lang, source from documents)) as repeats from documents"""

# --- pages ------------------------------------------------------------------------------------


def _damaged(spark, folder):
    """Pages with parts cut out by key: doctype, whole head, body tags, or nothing but the text."""
    html, key = F.col("html"), F.col("page_id")
    headless = F.concat(F.substring_index(html, "<head>", 1), F.substring_index(html, "</head>", -1))
    return read(spark, folder, "pages").select(
        "page_id",
        F.when(key % 5 == 0, F.replace(html, F.lit("<!DOCTYPE html>"), F.lit("")))
        .when(key % 5 == 1, headless)
        .when(key % 5 == 2, F.replace(F.replace(html, F.lit("<body>"), F.lit("")), F.lit("</body>"), F.lit("")))
        .when(key % 5 == 3, F.substring_index(html, "<body>", -1))
        .otherwise(F.replace(html, F.lit("<nav>"), F.lit("<nav>new Chart d3")))
        .alias("html"),
    )


DAMAGED = """
    select page_id, case
        when page_id % 5 = 0 then replace(html, '<!DOCTYPE html>', '')
        when page_id % 5 = 1 then split_part(html, '<head>', 1) || string_split(html, '</head>')[-1]
        when page_id % 5 = 2 then replace(replace(html, '<body>', ''), '</body>', '')
        when page_id % 5 = 3 then string_split(html, '<body>')[-1]
        else replace(html, '<nav>', '<nav>new Chart d3') end as html
    from pages"""

CHECKS = ["has_doctype", "has_html", "has_head", "has_charset", "has_body", "has_viewport", "has_csp", "unloaded_libraries"]


def page_audit(spark, folder):
    return audit_html(_damaged(spark, folder), "html").select("page_id", *CHECKS)


_L = "lower(html)"
_SQL_HEAD = f"""case when instr({_L}, '<head>') = 0 then ''
     when instr({_L}, '</head>') > 0 then substring(html, instr({_L}, '<head>'), greatest(instr({_L}, '</head>') - instr({_L}, '<head>'), 0))
     else substring(html, instr({_L}, '<head>')) end"""
_CSP = '<meta http-equiv="Content-Security-Policy"'
_VIEWPORT = '<meta name="viewport"'
PAGE_AUDIT = f"""
with d as ({DAMAGED}), h as (select *, {_SQL_HEAD} as head from d)
select page_id, starts_with(lower(trim(html, chr(32) || chr(9) || chr(10) || chr(13))), '<!doctype html') as has_doctype, contains({_L}, '<html') as has_html,
       contains({_L}, '<head>') as has_head, contains(lower(head), '<meta charset') as has_charset, contains({_L}, '<body') as has_body,
       contains(lower(head), '{_VIEWPORT}') as has_viewport, contains(head, '{_CSP}') as has_csp,
       concat_ws(',', case when contains(html, 'Chart') and not contains(html, 'chart.js') then 'Chart' end,
                 case when contains(html, 'd3') and not contains(html, 'd3.v7.min.js') then 'd3' end) as unloaded_libraries
from h"""


def page_repair(spark, folder):
    return repair_html(_damaged(spark, folder), "html")


# What repairs add, written out here so that the SQL checks the constants too.
EMPTY_PAGE = (
    "<!DOCTYPE html><html><head><meta charset='UTF-8'><title>Error</title></head><body><h2>No dashboard content generated.</h2></body></html>"
)
HTML_OPEN, BODY, CHARSET = "<html lang='en'>", "<body>\n</body>", '<meta charset="UTF-8">'
HEAD = '<head><meta charset="UTF-8"><title>Dashboard</title></head>'
VIEWPORT = '<meta name="viewport" content="width=device-width, initial-scale=1.0">'
LOADS = [("Chart", "chart.js", "https://cdn.jsdelivr.net/npm/chart.js"), ("d3", "d3.v7.min.js", "https://d3js.org/d3.v7.min.js")]


def _q(value):
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _insert(at, part):
    return f"substring(html, 1, {at}) || {part} || substring(html, {at} + 1)"


_STEPS = [
    f"case when coalesce(length(html), 0) = 0 then {_q(EMPTY_PAGE)} else html end",
    f"case when starts_with(lower(trim(html, chr(32) || chr(9) || chr(10) || chr(13))), '<!doctype html') then html else '<!DOCTYPE html>' || chr(10) || html end",
    f"case when contains({_L}, '<html') then html else case when instr(html, '<!DOCTYPE html>') > 0 then "
    + _insert("instr(html, '<!DOCTYPE html>') + 14", f"chr(10) || {_q(HTML_OPEN)}")
    + f" else html end || case when contains({_L}, '</html>') then '' else chr(10) || '</html>' end end",
    f"case when contains({_L}, '<head>') then html else "
    + _insert(f"(case when instr({_L}, '<html>') > 0 then instr({_L}, '<html>') + 5 else instr(html, '>') end)", f"chr(10) || {_q(HEAD)} || chr(10)")
    + " end",
    f"case when contains({_L}, '<head>') and not contains(lower({_SQL_HEAD}), '<meta charset') then "
    + _insert(f"instr({_L}, '<head>') + 5", f"{_q(CHARSET)} || chr(10)") + " else html end",
    f"case when contains({_L}, '<body') then html when instr({_L}, '</head>') > 0 then "
    + _insert(f"instr({_L}, '</head>') + 6", f"chr(10) || {_q(BODY)}") + f" when instr({_L}, '</html>') > 0 then "
    + _insert(f"instr({_L}, '</html>') - 1", f"chr(10) || {_q(BODY)} || chr(10)") + f" else html || chr(10) || {_q(BODY)} end",
    f"case when contains({_L}, '<head>') and not contains(lower({_SQL_HEAD}), '{_VIEWPORT}') then "
    + _insert(f"instr({_L}, '<head>') + 5", f"{_q(VIEWPORT)} || chr(10)") + " else html end",
] + [
    f"case when contains({_L}, '</head>') and contains(html, '{name}') and not contains(html, '{script}') then "
    + _insert(f"instr({_L}, '</head>') - 1", f"""'<script src="{address}"></script>' || chr(10)""") + " else html end"
    for name, script, address in LOADS
]
PAGE_REPAIR = (
    f"with s0 as ({DAMAGED}), "
    + ", ".join(f"s{i + 1} as (select page_id, {step} as html from s{i})" for i, step in enumerate(_STEPS))
    + f" select page_id, html from s{len(_STEPS)}"
)


def fenced_pages(spark, folder):
    """Pages wrapped in code fences by key and unwrapped again."""
    html, key = F.col("html"), F.col("page_id")
    fence = F.lit("```")
    wrapped = (
        F.when(key % 4 == 0, F.concat(F.lit("  ```html\n"), html, F.lit("\n```\n")))
        .when(key % 4 == 1, F.concat(fence, F.lit("\n"), html, F.lit("\n"), fence))
        .when(key % 4 == 2, F.concat(F.lit("```html\n"), html))
        .otherwise(F.concat(F.lit("\n\t"), html, F.lit(" ")))
    )
    pages = read(spark, folder, "pages").select("page_id", wrapped.alias("html"))
    return strip_code_fence(pages, "html")


FENCED_PAGES = "select page_id, trim(html, chr(32) || chr(9) || chr(10) || chr(13)) as html from pages"


QUERIES = {
    "order_records": order_records,
    "lineitem_kpis": lineitem_kpis,
    "suppliers_by_revenue": suppliers_by_revenue,
    "orders_over_time": orders_over_time,
    "segments_by_priority": segments_by_priority,
    "order_points": order_points,
    "filtered_orders": filtered_orders,
    "feeds_from_cube": feeds_from_cube,
    "lineitem_correlations": lineitem_correlations,
    "lineitem_rank_correlations": lineitem_rank_correlations,
    "quality_issues": quality_issues,
    "repeated_texts": repeated_texts,
    "page_audit": page_audit,
    "page_repair": page_repair,
    "fenced_pages": fenced_pages,
}

SQL = {
    "order_records": ORDER_RECORDS,
    "lineitem_kpis": LINEITEM_KPIS,
    "suppliers_by_revenue": SUPPLIERS_BY_REVENUE,
    "orders_over_time": ORDERS_OVER_TIME,
    "segments_by_priority": SEGMENTS_BY_PRIORITY,
    "order_points": ORDER_POINTS,
    "filtered_orders": FILTERED_ORDERS,
    "feeds_from_cube": FEEDS_FROM_CUBE,
    "lineitem_correlations": LINEITEM_CORRELATIONS,
    "lineitem_rank_correlations": LINEITEM_RANK_CORRELATIONS,
    "quality_issues": QUALITY_ISSUES,
    "repeated_texts": REPEATED_TEXTS,
    "page_audit": PAGE_AUDIT,
    "page_repair": PAGE_REPAIR,
    "fenced_pages": FENCED_PAGES,
}
