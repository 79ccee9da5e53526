"""The given tables, and how the catalog and gaps are laid over them."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.catalog import Catalog


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text(pattern: str, column: str):
    return F.date_format(F.col(column).cast("timestamp"), pattern)


# The tables have no gaps, so both sides make the same ones by key.

GAPPY_EVENTS = """
    select event_id, user_id,
           case when event_id % 7 = 0 then null else value end as value,
           case when event_id % 5 = 0 then null else event_type end as event_type,
           case when event_id % 10 = 3 then 'n/a' else strftime(ts, '%d.%m.%Y') end as day
    from events"""


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    return read(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.when(key % 7 != 0, F.col("value")).alias("value"),
        F.when(key % 5 != 0, F.col("event_type")).alias("event_type"),
        F.when(key % 10 == 3, "n/a").otherwise(text("dd.MM.yyyy", "ts")).alias("day"),
    )


GAPPY_LINEITEM = """
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount,
           case when l_orderkey % 11 = 0 then null else l_quantity end as l_quantity,
           case when l_partkey % 13 = 0 then null else l_returnflag end as l_returnflag,
           case when l_suppkey % 10 = 4 then 'unknown' else strftime(l_shipdate, '%Y/%m/%d') end as shipped
    from lineitem"""

LINEITEM_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def gappy_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_extendedprice",
        "l_discount",
        F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        F.when(F.col("l_suppkey") % 10 == 4, "unknown").otherwise(text("yyyy/MM/dd", "l_shipdate")).alias("shipped"),
    )


# Catalog: users are customers, datasets orders, dashboards events, shares line items. A third of
# all dashboards belongs to dataset 0, and some shares point to objects that do not exist.

CATALOG = """
    users as (
        select c_custkey as id, c_name as name,
               'user' || case when c_custkey % 50 = 1 then c_custkey - 1 else c_custkey end || '@example.org' as email
        from customer),
    datasets as (
        select o_orderkey as id, o_custkey as user_id, 'orders-' || o_orderkey || '.csv' as original_filename,
               case when o_orderkey % 2 = 0 then 'csv' else 'json' end as file_type,
               cast(floor(o_totalprice) as bigint) as n_rows, cast(length(o_orderpriority) as integer) as n_columns,
               o_orderkey % 5 = 0 as is_public, o_orderdate as uploaded_at
        from orders),
    visualisations as (
        select event_id as id, case when event_id % 3 = 0 then 0 else event_id end as dataset_id,
               event_type || '-' || event_id as title, ts as created_at
        from events),
    shares as (
        select o_custkey as owner_id, l_suppkey as target_id,
               case when l_orderkey % 2 = 0 then 'dataset' else 'visualisation' end as object_type,
               case when l_orderkey % 97 = 0 then l_orderkey + 1000000000 else l_orderkey end as object_id
        from lineitem join orders on l_orderkey = o_orderkey)"""


def catalog(spark: SparkSession, folder: str) -> Catalog:
    id_ = F.col("c_custkey")
    users = read(spark, folder, "customer").select(
        id_.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("user"), F.when(id_ % 50 == 1, id_ - 1).otherwise(id_), F.lit("@example.org")).alias("email"),
    )
    order = F.col("o_orderkey")
    datasets = read(spark, folder, "orders").select(
        order.alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("orders-"), order, F.lit(".csv")).alias("original_filename"),
        F.when(order % 2 == 0, "csv").otherwise("json").alias("file_type"),
        F.floor("o_totalprice").alias("n_rows"),
        F.length("o_orderpriority").alias("n_columns"),
        (order % 5 == 0).alias("is_public"),
        F.col("o_orderdate").cast("timestamp").alias("uploaded_at"),
    )
    event = F.col("event_id")
    visualisations = read(spark, folder, "events").select(
        event.alias("id"),
        F.when(event % 3 == 0, F.lit(0).cast("bigint")).otherwise(event).alias("dataset_id"),
        F.concat("event_type", F.lit("-"), event).alias("title"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    line = F.col("l_orderkey")
    owners = read(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner_id"))
    shares = (
        read(spark, folder, "lineitem")
        .select("l_orderkey", F.col("l_suppkey").alias("target_id"))
        .join(owners, "l_orderkey")
        .select(
            "owner_id",
            "target_id",
            F.when(line % 2 == 0, "dataset").otherwise("visualisation").alias("object_type"),
            F.when(line % 97 == 0, line + 1_000_000_000).otherwise(line).alias("object_id"),
        )
    )
    return Catalog(users, datasets, visualisations, shares)
