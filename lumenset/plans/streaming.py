"""Queries of the streaming jobs, in their table and their stream form."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators.profile_state import within
from ..session import scratch_path
from ..sources.csv import BAD, FILE, file_headers, read_csv_fields
from ..sources.infer import cast_types
from ..streaming.ingest import ID, ingest_stream
from ..streaming.quota import answer_requests, quota_violations, run_quota_stream, run_refusal_stream
from ..streaming.tenants import run_tenant_stream
from .tables import read, text

# the events of one user are few, so the limits are low
PER_HOUR, PER_DAY = 2, 8


def _shown(windows):
    return windows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def over_quota(spark, folder):
    return _shown(quota_violations(read(spark, folder, "events"), "user_id", "ts", PER_HOUR, PER_DAY))


OVER_QUOTA = " union all ".join(
    f"select user_id as client, '{g}' as grain, strftime(date_trunc('{g}', ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n "
    f"from events group by 1, 2, 3 having count(*) > {limit}"
    for g, limit in (("hour", PER_HOUR), ("day", PER_DAY))
)


def over_quota_stream(spark, folder):
    """The same counts from a stream of the events, run until all of them are read."""
    schema = read(spark, folder, "events").schema
    parts = []
    for grain, limit in (("hour", PER_HOUR), ("day", PER_DAY)):
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
        sink = scratch_path(spark, f"quota-{grain}")
        run_quota_stream(events, "user_id", "ts", grain, limit, sink, scratch_path(spark, "state"), output_mode="complete").awaitTermination()
        parts.append(spark.read.parquet(sink))
    return _shown(reduce(lambda a, b: a.unionByName(b), parts))


ANSWERED = ["client", "id", "at", "hour_number", "day_number", "accepted"]


def _answers(rows):
    return rows.select(*ANSWERED[:2], F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), *ANSWERED[3:])


def answered_requests(spark, folder):
    return _answers(answer_requests(read(spark, folder, "events"), "user_id", "ts", "event_id", PER_HOUR, PER_DAY))


ANSWERED_REQUESTS = f"""
with d as (select user_id as client, event_id as id, ts,
                  row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as hour_number,
                  row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) as day_number from events)
select client, id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at, hour_number, day_number, hour_number <= {PER_HOUR} and day_number <= {PER_DAY} as accepted from d"""


def answered_stream(spark, folder):
    """The same from a stream of four deliveries, later events in later ones: numbers go on over batches."""
    events, drop, sink, state = read(spark, folder, "events"), scratch_path(spark, "requests"), scratch_path(spark, "answers"), scratch_path(spark, "state")
    events = events.withColumn("at", F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx("at", [0.25, 0.5, 0.75])).first()[0]
    part = sum((F.col("at") > F.lit(c)).cast("int") for c in cuts)
    names = "user_id bigint, event_id bigint, at timestamp"
    for i in range(4):
        # the files of a delivery hold the same hours, so all of them are one batch: of two batches the second would be late
        events.filter(part == i).select("user_id", "event_id", "at").write.mode("append").parquet(f"{drop}/{i}")
        stream = spark.readStream.schema(names).option("recursiveFileLookup", True).parquet(drop)
        run_refusal_stream(stream, "user_id", "at", "event_id", sink, state, PER_HOUR, PER_DAY).awaitTermination()
    return _answers(spark.read.parquet(sink))


def tenant_batches(spark, folder):
    """Events in four files, taken one after the other, a third of them of one tenant: what each batch filled, and how far its medians lie from their ranks."""
    key = F.col("event_id")
    events = read(spark, folder, "events").select(
        F.when(key % 3 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("user_id") % 20).alias("user"), "event_id",
        F.when(key % 7 != 0, F.col("value")).alias("value"), F.when(key % 5 != 0, F.col("event_type")).alias("kind"), (key % 4).alias("part"),
    )
    drop, sink, state = (scratch_path(spark, name) for name in ("tenants", "cleaned", "states"))
    for i in range(4):
        events.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{drop}/{i}")
    stream = spark.readStream.schema(events.drop("part").schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(drop)
    run_tenant_stream(stream, state, sink, scratch_path(spark, "state"), "user", ["value"], ["kind"]).awaitTermination()
    cleaned = spark.read.parquet(sink).withColumn("gap", F.col("event_id") % 7 == 0)
    used = cleaned.groupBy("user", "batch").agg(
        F.count("*").alias("n"), F.count_if("gap").alias("n_filled"), F.max(F.when(F.col("gap"), F.col("value"))).alias("median"),
        F.max(F.when(F.col("event_id") % 5 == 0, F.col("kind"))).alias("kind_filled"),
    )
    # the place of each median among the values of its tenant up to its batch
    values = events.where("value is not null").select(F.col("user").alias("of"), "value", "part")
    near = used.join(values, (F.col("user") == F.col("of")) & (F.col("part") <= F.col("batch"))).groupBy(F.struct("user", "batch").alias("k")).agg(
        F.count("*").alias("all"), F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("upto")
    )
    off = F.greatest(F.col("below") / F.col("all") - 0.5, 0.5 - F.col("upto") / F.col("all"))
    near = near.select("k.*", F.col("all").alias("n_values"), within(off).alias("near"))
    return used.join(near, ["user", "batch"]).select("user", "batch", "n", "n_filled", F.coalesce("kind_filled", F.lit("")).alias("kind_filled"), "n_values", "near")


TENANT_BATCHES = """
with e as (select case when event_id % 3 = 0 then -1 else user_id % 20 end as user, event_id, event_id % 4 as part,
                  case when event_id % 7 = 0 then null else value end as value, case when event_id % 5 = 0 then null else event_type end as kind from events),
     b as (select user, part as batch, count(*) as n, count(*) filter (event_id % 7 = 0) as n_filled, count(*) filter (event_id % 5 = 0) as kinds from e group by 1, 2),
     c as (select b.user, batch, kind, count(*) as m from b join e on e.user = b.user and e.part <= b.batch where kind is not null group by 1, 2, 3),
     m as (select user, batch, kind from c qualify row_number() over (partition by user, batch order by m desc, kind) = 1),
     v as (select b.user, batch, count(value) as n_values from b join e on e.user = b.user and e.part <= b.batch group by 1, 2)
select b.user as "user", b.batch, n, n_filled, case when kinds = 0 then '' else coalesce(m.kind, '') end as kind_filled, n_values, true as near
from b join v on v.user = b.user and v.batch = b.batch left join m on m.user = b.user and m.batch = b.batch where n_values > 0"""

# keys per dropped file: files are as large for a large table as for a small one
ORDERS_EACH, CUSTOMERS_EACH = 100_000, 10_000


def _drop_orders(spark, folder, drop):
    """Orders as one CSV file per status, year and ORDERS_EACH keys, columns in two orders, and one file of a header alone."""
    key = F.col("o_orderkey")
    part = F.concat("o_orderstatus", text("yyyy", "o_orderdate"), F.lit("-"), F.floor(key / ORDERS_EACH))
    orders = read(spark, folder, "orders").select(
        part.alias("part"),
        F.concat(F.lit("s-"), part).alias("label"),
        "o_orderkey",
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        text("d MMM yyyy", "o_orderdate").alias("day"),
    )
    swapped = orders.select("part", "day", "o_orderpriority", "label", "o_totalprice", "o_orderkey")
    for name, rows in (("open", orders.filter("part like 'O%'")), ("other", swapped.filter("part not like 'O%'"))):
        sorted_rows = rows.repartition("part").sortWithinPartitions("part", "o_orderkey")
        sorted_rows.write.partitionBy("part").option("header", True).csv(f"{drop}/{name}")
    orders.drop("part").limit(0).write.option("header", True).csv(f"{drop}/empty")


def ingested_orders(spark, folder):
    """The cleaned rows of dropped CSV files, each cleaned with its own statistics, and what was registered of its file."""
    drop, sink = scratch_path(spark, "drop"), scratch_path(spark, "sink")
    _drop_orders(spark, folder, drop)
    ingest_stream(spark, drop, sink, scratch_path(spark, "state"), user_id=1, pattern="*.csv").awaitTermination()
    known = spark.read.parquet(f"{sink}/datasets").filter("n_rows > 0").select("id", "n_rows", "n_columns")
    written = f"{sink}/rows/batch=*/table=*/{ID}=*"
    rows = read_csv_fields(spark, written, file_headers(spark, written))
    rows = rows.withColumn("id", F.regexp_extract(FILE, f"{ID}=(\\d+)", 1).cast("long")).drop(FILE, BAD)
    kinds = {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderkey_outlier": "boolean", "o_totalprice_outlier": "boolean"}
    out = cast_types(rows, kinds).join(known, "id").drop("id")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


def _drop_customers(spark, folder, drop):
    """Customers as one JSON document per nation and CUSTOMERS_EACH keys."""
    block = F.floor(F.col("c_custkey") / CUSTOMERS_EACH).alias("block")
    members = F.sort_array(F.collect_list(F.struct("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")))
    customers = read(spark, folder, "customer").groupBy("c_nationkey", block).agg(members.alias("customers"))
    customers.select("customers").write.option("maxRecordsPerFile", 1).json(f"{drop}/json")


def ingested_customers(spark, folder):
    """The cleaned rows of dropped JSON documents, each cleaned with its own statistics."""
    drop, sink = scratch_path(spark, "drop"), scratch_path(spark, "sink")
    _drop_customers(spark, folder, drop)
    ingest_stream(spark, drop, sink, scratch_path(spark, "state"), user_id=1).awaitTermination()
    kinds = "c_custkey bigint, c_acctbal double, c_mktsegment string, c_nationkey bigint, _key string"
    flags = ", ".join(f"{c}_outlier boolean" for c in ("c_custkey", "c_acctbal", "c_nationkey"))
    rows = spark.read.schema(f"{kinds}, {flags}").json(f"{sink}/rows/batch=*/table=*/{ID}=*")
    return rows.withColumn("c_acctbal", F.round("c_acctbal", 6)).withColumnRenamed("_key", "found_under")


def ingested_mixed(spark, folder):
    """What is registered and what is refused of a drop folder of CSV files and JSON documents, one file being unreadable."""
    drop, sink = scratch_path(spark, "drop"), scratch_path(spark, "sink")
    _drop_orders(spark, folder, drop)
    _drop_customers(spark, folder, drop)
    # a record longer than its header
    spark.createDataFrame([("1,2",)], "a string").coalesce(1).write.option("header", True).option("sep", "|").csv(f"{drop}/bad")
    ingest_stream(spark, drop, sink, scratch_path(spark, "state"), user_id=1).awaitTermination()
    known = spark.read.parquet(f"{sink}/datasets").groupBy("file_type", "n_columns").agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"))
    refused = spark.read.parquet(f"{sink}/rejected").groupBy(F.col("reason").alias("file_type")).agg(F.count("*").alias("n_files"))
    return known.unionByName(refused.select("file_type", F.lit(0).alias("n_columns"), "n_files", F.lit(0).cast("long").alias("n_rows")))


INGESTED_MIXED = f"""
select 'csv' as file_type, 8 as n_columns, count(distinct (o_orderstatus, year(o_orderdate), o_orderkey // {ORDERS_EACH})) as n_files, count(*) as n_rows from orders
union all select 'csv', 5, 1, 0
union all select 'json', 8, count(distinct (c_nationkey, c_custkey // {CUSTOMERS_EACH})), count(*) from customer
union all select 'a record has more fields than the header of its file', 0, 1, 0"""


def _flag(c):
    return f"coalesce({c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) or {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1), false) as {c}_outlier"


def _quartiles(c):
    return f"quantile_cont({c}, 0.25) as {c}_q1, quantile_cont({c}, 0.75) as {c}_q3"


INGESTED_ORDERS = f"""
with d as (select 's-' || o_orderstatus || year(o_orderdate) || '-' || o_orderkey // {ORDERS_EACH} as label, o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice,
                  case when o_orderkey % 5 = 0 then null else o_orderpriority end as o_orderpriority, o_orderdate from orders),
     c as (select label, o_orderpriority as fill, count(*) as n from d where o_orderpriority is not null group by all),
     m as (select label, fill from c qualify row_number() over (partition by label order by n desc, fill) = 1),
     k as (select label, quantile_cont(o_totalprice, 0.5) as median, count(*) as n_rows from d group by label),
     f as (select label, o_orderkey, coalesce(o_totalprice, median) as o_totalprice, coalesce(o_orderpriority, fill) as o_orderpriority, o_orderdate, n_rows
           from d join k using (label) join m using (label)),
     q as (select label, {_quartiles('o_orderkey')}, {_quartiles('o_totalprice')} from f group by label)
select label, o_orderkey, round(o_totalprice, 6) as o_totalprice, o_orderpriority,
       ltrim(strftime(o_orderdate, '%d %b %Y'), '0') as day, {_flag('o_orderkey')}, {_flag('o_totalprice')},
       strftime(o_orderdate, '%Y-%m-%d') as day_date, n_rows, 8 as n_columns
from f join q using (label)"""


INGESTED_CUSTOMERS = f"""
with d as (select *, c_custkey // {CUSTOMERS_EACH} as block from customer),
     q as (select c_nationkey, block, {_quartiles('c_custkey')}, {_quartiles('c_acctbal')} from d group by all)
select c_custkey, round(c_acctbal, 6) as c_acctbal, c_mktsegment, c_nationkey, 'customers' as found_under, {_flag('c_custkey')}, {_flag('c_acctbal')},
       false as c_nationkey_outlier
from d join q using (c_nationkey, block)"""


QUERIES = {
    "answered_requests": answered_requests,
    "answered_stream": answered_stream,
    "tenant_batches": tenant_batches,
    "ingested_customers": ingested_customers,
    "over_quota": over_quota,
    "over_quota_stream": over_quota_stream,
    "ingested_orders": ingested_orders,
    "ingested_mixed": ingested_mixed,
}

SQL = {
    "answered_requests": ANSWERED_REQUESTS,
    "answered_stream": ANSWERED_REQUESTS,
    "tenant_batches": TENANT_BATCHES,
    "ingested_customers": INGESTED_CUSTOMERS,
    "over_quota": OVER_QUOTA,
    "over_quota_stream": OVER_QUOTA,
    "ingested_orders": INGESTED_ORDERS,
    "ingested_mixed": INGESTED_MIXED,
}
