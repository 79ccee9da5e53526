import statistics

import pytest
from pyspark.sql import functions as F

from lumenset.streaming import tenants as t

SCHEMA = "`the tenant` string, id bigint, price double, kind string, price_outlier int"
BATCHES = [
    [("a", 1, 1.0, "x", 9), ("a", 2, None, None, 9), ("a", 3, 3.0, "y", 9), ("b", 4, None, None, 9), (None, 5, 7.0, "z", 9), (None, 6, float("nan"), None, 9)],
    [("a", 7, None, None, 9), ("a", 8, 5.0, "y", 9), ("a", 9, 5.0, "y", 9), ("a", 10, 500.0, "", 9)],
    [("b", 11, None, "q", 9), ("b", 12, 2.0, None, 9)],
]
ARGS = ("the tenant", ["price"], ["kind"])


def test_later_batches_use_all_before_them(spark, tmp_path):
    state, sink = f"{tmp_path}/state", f"{tmp_path}/sink"
    for batch, rows in enumerate(BATCHES):
        for _ in range(2):  # a batch that is run again changes nothing
            t.take_batch(spark.createDataFrame(rows, SCHEMA), batch, state, sink, *ARGS)
    got = spark.read.parquet(sink).collect()
    assert len(got) == sum(map(len, BATCHES)) and set(spark.read.parquet(sink).columns) == {"the tenant", "id", "price", "kind", "price_outlier", "batch"}
    seen = {r.id: r for r in got}
    for batch, rows in enumerate(BATCHES):
        before = [r for b in BATCHES[: batch + 1] for r in b]
        for tenant, number, price, kind, _ in rows:
            prices = [r[2] for r in before if r[0] == tenant and r[2] is not None and r[2] == r[2]]
            kinds = [r[3] for r in before if r[0] == tenant and r[3] is not None]
            if price is None or price != price:
                assert seen[number].price == (statistics.median_low(prices) if prices else None)
            if kind is None:
                assert seen[number].kind == (min(kinds, key=lambda k: (-kinds.count(k), k)) if kinds else None)
    assert seen[10].price_outlier and not seen[8].price_outlier and not seen[4].price_outlier


def test_empty_batches_and_states_of_touched_tenants(spark, tmp_path):
    state, sink = f"{tmp_path}/state", f"{tmp_path}/sink"
    first = spark.createDataFrame(BATCHES[0], SCHEMA)
    t.take_batch(first.limit(0), 0, state, sink, *ARGS)
    t.take_batch(first, 1, state, sink, *ARGS)
    assert spark.read.parquet(sink).count() == 6
    one = t.tenant_statistics(spark, state, *ARGS[1:], 1, spark.createDataFrame([(None,)], "tenant string")).collect()
    assert [(r.tenant, r.n, r.median0, r.mode0) for r in one] == [(None, 2, 7.0, "z")]
    with pytest.raises(ValueError):
        t._checked(["price"], ["price"], "the tenant")


def test_quantiles_of_a_large_tenant_keep_their_rank(spark, tmp_path):
    rows = spark.range(40_000).select(F.lit("h").alias("who"), F.expr("cast(pmod(id * 7919, 40009) as double)").alias("v"), (F.col("id") % 3).alias("part"))
    for part in range(3):
        t.add_tenant_state(rows.where(F.col("part") == part), str(tmp_path), part, "who", ["v"], [])
    found = t.tenant_statistics(spark, str(tmp_path), ["v"], [], 2).first()
    below = rows.where(F.col("v") < found.median0).count() / 40_000
    assert found.n == 40_000 and abs(below - 0.5) <= 0.005
