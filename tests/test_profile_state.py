"""States of loads, merged, against the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenset.operators.profile_state import RANK_ERROR, STATE, add_load, iqr_bounds_of, known_values, merged_profile, rank_errors
from lumenset.streaming.quota import answer_requests, run_refusal_stream

GIVEN = f"{STATE}, load string"
PLACES = [0.1, 0.25, 0.5, 0.75, 0.9]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(v), None if i % 5 else float(i), f"t{i % 700}", bool(i % 2), None) for i, v in enumerate(np.exp(rng.standard_normal(9000)))]
    frame = spark.createDataFrame(rows, "i bigint, x double, gappy double, t string, b boolean, empty double")
    return frame.withColumn("at", F.timestamp_seconds(F.col("i") * 60)).repartition(4)


def test_merged_states_are_the_whole_table(spark, table, tmp_path):
    path = f"{tmp_path}/states"
    for load in (0, 1, 2, 0):
        add_load(table.where(F.col("i") % 3 == load), path, load)
    states = spark.read.schema(GIVEN).parquet(path)
    merged = merged_profile(states, PLACES)
    got = {r["column"]: r for r in merged.collect()}
    assert [c for c in sorted(got, key=lambda c: got[c].position)] == table.columns
    for c in ("i", "x", "gappy"):
        v = np.array([r[0] for r in table.select(c).where(f"{c} is not null").collect()])
        r = got[c]
        assert (r.n_rows, r.n, r["min"], r["max"]) == (9000, len(v), v.min(), v.max())
        assert r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std(ddof=1))
    errors = rank_errors(table, known_values(merged, PLACES)).collect()
    assert len(errors) == 4 * len(PLACES) and all(e.error <= RANK_ERROR for e in errors)
    assert got["empty"].n == 0 and got["empty"].median is None and got["empty"]["std"] is None
    assert got["t"].unique_values == pytest.approx(700, rel=0.06)
    assert (got["at"].first, got["at"].last) == table.agg(F.min("at"), F.max("at")).first()
    bounds = {r.column: r for r in iqr_bounds_of(states).collect()}
    assert bounds["i"].lower == pytest.approx(-4500, rel=0.05) and bounds["i"].upper == pytest.approx(13500, rel=0.05)


def test_loads_of_other_columns_types_and_no_rows(spark, tmp_path):
    path = f"{tmp_path}/states"
    add_load(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), path, "a")
    add_load(spark.createDataFrame([(3, 1.5)], "k int, w double"), path, "b")
    add_load(spark.createDataFrame([], "k int, v string"), path, "c")
    add_load(spark.createDataFrame([("x",)], "w string"), path, "d")
    got = {r["column"]: r for r in merged_profile(spark.read.schema(GIVEN).parquet(path)).collect()}
    assert {c: (r.type, r.n_rows, r.n) for c, r in got.items()} == {"k": ("int64", 4, 3), "v": ("object", 4, 1), "w": ("object", 4, 2)}
    assert got["k"].median == 2 and got["k"]["std"] == 1


def test_requests_are_refused_when_they_arrive(spark, tmp_path):
    """The third and later ones of an hour and the sixth of a day, over batches and hours; state of past days goes."""
    rows, number = [], 0
    for batch, hours in enumerate(([0, 0, 1], [1, 1, 2, 2], [2, 3, 30, 30], [30, 31, 80])):
        for hour in hours:
            for client in (1, 2) if hour != 31 else (2,):
                rows.append((batch, client, number, 86400 * 20_000 + hour * 3600 + number))
                number += 1
    table = spark.createDataFrame(rows, "batch int, client bigint, id bigint, second bigint").withColumn("at", F.timestamp_seconds("second"))
    for batch in range(4):
        table.where(F.col("batch") == batch).select("client", "id", "at").coalesce(1).write.parquet(f"{tmp_path}/in/{batch}")
    stream = spark.readStream.schema("client bigint, id bigint, at timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run_refusal_stream(stream, "client", "at", "id", f"{tmp_path}/out", f"{tmp_path}/state", 2, 5, "30 minutes").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda r: r[1])
    want = sorted(map(tuple, answer_requests(table, "client", "at", "id", 2, 5).select("client", "id", "at", "hour_number", "day_number", "accepted").collect()), key=lambda r: r[1])
    assert got == want
    assert sum(not r[5] for r in got) >= 6
