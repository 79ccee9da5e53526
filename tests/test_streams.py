import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lumenset.plans.streaming import answered_requests, answered_stream
from lumenset.plans.tables import read
from lumenset.streaming import ingest, quota
from lumenset.streaming.ingest import ingest_stream
from lumenset.streaming.quota import over_quota, quota_violations, run_quota_stream


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def stream(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def rows(df):
    return sorted((r.client, r.grain, str(r.window_start), r.n) for r in df.collect())


def test_limits_are_exceeded_not_reached(spark):
    events = spark.sql("select 1 as who, timestamp'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id) as at from range(51)")
    assert rows(quota_violations(events, "who", "at")) == [(1, "hour", "2024-01-01 10:00:00", 51)]
    assert rows(quota_violations(events.limit(50), "who", "at")) == []


def test_complete_stream_equals_table(spark, sf_dir, folder):
    run_quota_stream(stream(spark, sf_dir), "user_id", "ts", "day", 8, folder + "/out", folder + "/state", output_mode="complete").awaitTermination()
    want = over_quota(read(spark, sf_dir, "events"), "user_id", "ts", "day", 8)
    assert rows(spark.read.parquet(folder + "/out")) == rows(want) != []


def test_append_stream_gives_the_closed_windows(spark, sf_dir, folder):
    query = run_quota_stream(stream(spark, sf_dir), "user_id", "ts", "hour", 0, folder + "/out", folder + "/state")
    query.awaitTermination()
    events = read(spark, sf_dir, "events")
    last = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    closed = over_quota(events, "user_id", "ts", "hour", 0).where(F.expr("window_start + interval 1 hour") <= F.lit(last) - F.expr("interval 1 hour"))
    assert rows(spark.read.parquet(folder + "/out")) == rows(closed)


def test_files_are_cleaned_apart_and_taken_in_once(spark, folder):
    os.makedirs(folder + "/drop")

    def put(name, text):
        with open(f"{folder}/drop/{name}", "w", newline="") as f:
            f.write(text)

    def run():
        ingest_stream(spark, folder + "/drop", folder + "/sink", folder + "/state", user_id=7, max_bytes=2000).awaitTermination()
        known = spark.read.parquet(folder + "/sink/datasets").collect()
        refused = {r.file.rsplit("/", 1)[-1]: r.reason for r in spark.read.parquet(folder + "/sink/rejected").collect()}
        return {r.original_filename: r for r in known}, refused

    def rows(dataset):
        found = spark.read.option("header", True).csv(dataset.file_path) if dataset.file_type == "csv" else spark.read.json(dataset.file_path)
        return [r.asDict() for r in found.orderBy(found.columns[0]).collect()]

    header = "id,amount,kind,day\n"
    put("a.csv", header + "1,10,x,2024-01-01\n2,,x,2024-01-02\n3,20,NA,bad\n")
    put("b.csv", "amount,id,kind,day\n100,1,,05.02.2024\nNaN,2,q,06.02.2024\n")
    put("header.csv", "id,amount\n")
    put("long.csv", header + "1,2,3,4,5\n")
    put("empty.csv", "\n")
    put("huge.csv", header + "1,10,x,2024-01-01\n" * 200)
    put("notes.txt", "x")
    put("l.json", '[{"n":1,"t":"a"},{"n":null,"t":"a"},{"t":null,"n":4}]')
    put("k.json", '{"east":[{"v":1.5},{"v":2.5}],"west":{"v":9}}')
    put("bad.json", '{"a":')
    put("mixed.json", '[{"a":1},2]')
    known, refused = run()
    assert {n: (r.n_rows, r.n_columns, r.file_type, r.user_id, r.is_public) for n, r in known.items()} == {
        "a.csv": (3, 7, "csv", 7, False), "b.csv": (2, 7, "csv", 7, False), "header.csv": (0, 2, "csv", 7, False),
        "l.json": (3, 3, "json", 7, False), "k.json": (3, 3, "json", 7, False),
    }
    assert set(refused) == {"long.csv", "empty.csv", "huge.csv", "notes.txt", "bad.json", "mixed.json"}
    assert "more fields" in refused["long.csv"] and refused["huge.csv"] == "File too large" and "objects only" in refused["mixed.json"]
    assert [(r["id"], r["amount"], r["kind"], r["day_date"]) for r in rows(known["a.csv"])] == [
        ("1", "10.0", "x", "2024-01-01"), ("2", "15.0", "x", "2024-01-02"), ("3", "20.0", "x", None)
    ]
    assert sorted((r["id"], r["amount"], r["kind"], r["day_date"]) for r in rows(known["b.csv"])) == [
        ("1", "100.0", "q", "2024-02-05"), ("2", "100.0", "q", "2024-02-06")
    ]
    assert sorted((r["n"], r["t"]) for r in rows(known["l.json"])) == [(1.0, "a"), (2.5, "a"), (4.0, "a")]
    assert sorted((r["_key"], r["v"]) for r in rows(known["k.json"])) == [("east", 1.5), ("east", 2.5), ("west", 9.0)]
    assert len({r.id for r in known.values()}) == 5
    assert run() == (known, refused)
    put("c.csv", header + "7,1,z,none\n")
    later, _ = run()
    assert (later["c.csv"].n_rows, later["c.csv"].n_columns) == (1, 6) and later["c.csv"].id > max(r.id for r in known.values())


def test_a_file_of_too_many_fields_is_set_aside(spark, folder, monkeypatch):
    monkeypatch.setattr(ingest, "MAX_FIELDS", 5, raising=False)
    os.makedirs(folder + "/drop")
    for name, text in (("ids.json", "{" + ",".join(f'"{i}":{i}' for i in range(6)) + "}"), ("good.json", '[{"a":1,"b":2},{"c":3,"d":4,"e":5}]')):
        with open(f"{folder}/drop/{name}", "w") as f:
            f.write(text)
    ingest_stream(spark, folder + "/drop", folder + "/sink", folder + "/state", user_id=7).awaitTermination()
    assert [(r.original_filename, r.n_rows) for r in spark.read.parquet(folder + "/sink/datasets").collect()] == [("good.json", 2)]
    refused = spark.read.parquet(folder + "/sink/rejected").collect()
    assert [(r.file.rsplit("/", 1)[-1], r.reason) for r in refused] == [("ids.json", "the objects have more than 5 fields")]


def test_groups_of_a_batch_are_taken_side_by_side(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    for i in range(5):
        head = "a,b" if i % 2 else "b,a"
        (tmp_path / "drop" / f"f{i}.csv").write_text(head + "\n" + "".join(f"{i},{k}\n" for k in range(i + 1)))
    (tmp_path / "drop" / "f5.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "drop" / "f6.csv").write_text("a,b\n1,2,3\n")
    folder = f"file://{tmp_path}"
    ingest_stream(spark, folder + "/drop", folder + "/sink", folder + "/state", user_id=7, files_per_batch=2).awaitTermination()
    known = {r["original_filename"]: r for r in spark.read.parquet(folder + "/sink/datasets").collect()}
    assert {r["batch"] for r in known.values()} == {0}  # one group a batch made four of them
    assert [known[f"f{i}.csv"]["id"] for i in range(5)] + [known["f5.json"]["id"]] == [1, 2, 3, 4, 5, 6]
    assert {n: r["n_rows"] for n, r in known.items()} == {**{f"f{i}.csv": i + 1 for i in range(5)}, "f5.json": 2}
    for i in range(5):
        read = spark.read.option("header", True).csv(known[f"f{i}.csv"]["file_path"]).collect()
        first, second = ("a", "b") if i % 2 else ("b", "a")
        assert sorted((r[first], r[second]) for r in read) == [(str(i), str(k)) for k in range(i + 1)]
    assert [r["reason"] for r in spark.read.parquet(folder + "/sink/rejected").collect()] == ["a record has more fields than the header of its file"]


def test_requests_of_many_files_are_all_answered(spark, folder):
    events = spark.range(3000).select(
        (F.col("id") * 7 % 40).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 211 % 800_000).cast("timestamp_ntz").alias("ts")
    )
    events.repartition(5).write.parquet(folder + "/events.parquet")  # each of them holds all hours, and so does each file of a delivery
    got, want = (sorted(map(tuple, f(spark, folder).collect())) for f in (answered_stream, answered_requests))
    assert got == want and len(got) == 3000
    assert len({r[5] for r in got}) == 2


def test_clients_share_states(spark, folder, monkeypatch):
    """Few states for many clients, counts of which go on over batches and runs; nulls and large ids stay as they are."""
    monkeypatch.setattr(quota, "BUCKETS", 3)
    n, large = F.col("id"), 2**53
    rows = spark.range(900).select(
        F.when(n % 31 != 30, n % 31 + large).alias("client"), F.when(n % 53 != 52, n + large).alias("id"),
        F.timestamp_seconds(1_700_000_000 + n * 150).alias("at"), F.floor(n / 300).alias("batch"),
    )
    for batch in range(3):
        rows.where(F.col("batch") == batch).drop("batch").write.parquet(f"{folder}/in/{batch}")
        stream = spark.readStream.schema("client bigint, id bigint, at timestamp").option("recursiveFileLookup", True).parquet(f"{folder}/in")
        query = quota.run_refusal_stream(stream, "client", "at", "id", f"{folder}/out", f"{folder}/state", 1, 10)
        query.awaitTermination()
        assert 0 < query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 3
    got, want = (spark.read.parquet(f"{folder}/out"), quota.answer_requests(rows, "client", "at", "id", 1, 10))
    assert got.count() == 900 and got.where("client is null").count() == 29 and got.where("not accepted").count() > 50
    assert got.select(*want.columns).exceptAll(want).isEmpty()
