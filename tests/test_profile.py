import json
import statistics

from lumenset.operators.profile import (
    datetime_summary, distinct_counts, example_values, excerpt, numeric_summary, preview, profile_json,
    profile_table, schema_profile, table_shape, top_values,
)
from lumenset.operators.values import find_modes


def sample(spark):
    rows = [(i, float(i) if i % 4 else None, i % 2 == 0, f"c{i % 3}", f"v{(i * 7) % 12}", None) for i in range(24)]
    return spark.createDataFrame(rows, "id int, x double, even boolean, few string, many string, none string")


def test_numeric_summary(spark):
    df = sample(spark)
    got = {r["column"]: r for r in numeric_summary(df).collect()}
    xs = [float(i) for i in range(24) if i % 4]
    assert got["x"]["min"] == 1.0 and got["x"]["max"] == 23.0
    assert got["x"]["median"] == statistics.median(xs)
    assert abs(got["x"]["std"] - statistics.stdev(xs)) < 1e-9
    assert got["even"]["mean"] == 0.5
    one = numeric_summary(df.where("id = 1").select("x")).first()
    assert one["std"] is None and one["median"] == 1.0


def test_text_statistics(spark):
    df = sample(spark)
    assert {r["column"]: r["unique_values"] for r in distinct_counts(df).collect()} == {"few": 3, "many": 12, "none": 0}
    top = [(r["value"], r["n"]) for r in top_values(df).orderBy("place").collect()]
    assert top == [("c0", 8), ("c1", 8), ("c2", 8)]
    examples = {r["column"]: r["example_values"] for r in example_values(df, order_by="id").collect()}
    assert examples == {"many": ["v0", "v7", "v2"], "none": []}


def test_profile_document(spark):
    df = sample(spark)
    doc = json.loads(profile_json(df, "up.csv", "csv", order_by="id").first()[0])
    assert (doc["original_filename"], doc["n_rows"], doc["n_columns"]) == ("up.csv", 24, 6)
    info = doc["column_info"]
    assert list(info) == df.columns
    assert info["few"]["top_values"] == {"c0": 8, "c1": 8, "c2": 8} and "example_values" not in info["few"]
    assert info["many"]["example_values"] == ["v0", "v7", "v2"] and info["none"]["example_values"] == []
    assert info["x"]["type"] == "float64" and info["id"]["type"] == "int64" and info["even"]["type"] == "bool"
    assert set(info["x"]) == {"type", "name", "min", "max", "mean", "median", "std"}
    single = json.loads(profile_json(df.where("id = 1"), "up.csv", "csv", order_by="id").first()[0])
    assert single["column_info"]["x"]["std"] is None


def test_profile_of_datetimes_and_schema(spark):
    df = spark.sql("select timestamp'2024-01-02 03:04:05.5' a, date'2024-01-01' b, 'x' c")
    assert {r["column"]: (r["first"], r["last"]) for r in datetime_summary(df).collect()} == {
        "a": ("2024-01-02T03:04:05.500000",) * 2, "b": ("2024-01-01T00:00:00",) * 2
    }
    assert [(r["name"], r["type"]) for r in schema_profile(df).collect()] == [("a", "datetime"), ("b", "datetime"), ("c", "object")]
    assert [r["type"] for r in profile_table(df).orderBy("position").collect()] == ["datetime", "datetime", "object"]
    assert table_shape(df).first() == (1, 3)


def test_preview_and_excerpt(spark):
    df = sample(spark).select("id", "few", "none")
    assert [r.id for r in preview(df, 4, "id").collect()] == [0, 1, 2, 3]
    assert preview(df, 100).count() == 24
    text = excerpt(df, "csv", 20, "id").first()[0]
    assert text == "id,few,none\n0,c0,\n1,c1,"[:20] + "..."
    assert json.loads(excerpt(df, "json", 2000, "id").first()[0])[1] == {"id": 1, "few": "c1", "none": None}


def test_long_values_are_looked_up(spark):
    long = lambda i: f"{i:02d}" + "x" * 100
    rows = [(i, long(i % 3), long(i), "y" * 70 if i % 2 else "short") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, few string, many string, two string").repartition(4)
    assert {r["column"]: r["unique_values"] for r in distinct_counts(df).collect()} == {"few": 3, "many": 20, "two": 2}
    info = {r["name"]: r for r in profile_table(df, order_by="id").collect()}
    assert info["few"]["top_values"] == {long(0): 7, long(1): 7, long(2): 6}
    assert info["many"]["example_values"] == [long(0), long(1), long(2)]
    assert info["two"]["top_values"] == {"short": 10, "y" * 70: 10}


def test_modes_of_long_values(spark):
    a, b, c = "a" * 80, "b" * 80, "c" * 80
    rows = [(b, b, b, a), (b, a, "z", a), (a, c, "z", "k"), (a, "d" * 90, b, "k"), (c, "e" * 90, "q", "k")]
    df = spark.createDataFrame(rows, "tie string, unique string, mixed string, short string")
    assert find_modes(df, df.columns) == {"tie": a, "unique": a, "mixed": b, "short": "k"}
