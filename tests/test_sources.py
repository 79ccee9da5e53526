import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lumenset.operators.clean import clean
from lumenset.session import ROW_ID
from lumenset.sources.csv import read_csv_table
from lumenset.sources.infer import fit_types
from lumenset.sources.json import convert_named_dates, flatten_keyed_json, read_json_documents, read_json_records
from lumenset.sources.registry import Upload, add_existing, append_dataset, read_datasets
from lumenset.sources.sinks import register_dataset, take_upload, write_table
from lumenset.sources.uploads import check_uploads, upload_manifest


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_types_and_missing_tokens(spark, folder):
    path = put(folder, "a.csv", 'i,g,d,b,s,q,n,z\n1,1,1.5,True,x,"a, ""b""",NA,5d\n2,,1e3,false,NA,"",null,6\n3,4, 7 ,TRUE,y,c,,7\n')
    df = read_csv_table(spark, path).drop(ROW_ID)
    assert dict(df.dtypes) == {"i": "bigint", "g": "double", "d": "double", "b": "boolean", "s": "string", "q": "string", "n": "double", "z": "string"}
    rows = df.collect()
    assert [r.d for r in rows] == [1.5, 1000.0, 7.0]
    assert [r.q for r in rows] == ['a, "b"', None, "c"] and [r.s for r in rows] == ["x", None, "y"]


def test_multi_line_values(spark, folder):
    path = put(folder, "m.csv", 'k,t\n1,"two\nlines"\n2,one\n')
    assert [r.t for r in read_csv_table(spark, path).collect()] == ["two\nlines", "one"]
    with pytest.raises(ValueError, match="line break"):
        read_csv_table(spark, path, multi_line=False)


def test_csv_to_cleaned_csv(spark, folder):
    path = put(folder, "d.csv", "date_col,value\n2023-01-01,100\n2023-02-15,200\n2023-03-30,300\n")
    cleaned = clean(read_csv_table(spark, path), ROW_ID)
    table = folder + "/known"
    assert register_dataset(cleaned, table, Upload(1, "d.csv", folder + "/out", "csv")) == 1
    assert take_upload(spark, path, table, Upload(2, "d.csv", folder + "/again", "csv", True)) == 2
    rows = read_datasets(spark, table).orderBy("id").collect()
    assert [(r.id, r.n_rows, r.n_columns, r.file_type, r.is_public) for r in rows] == [(1, 3, 4, "csv", False), (2, 3, 4, "csv", True)]
    again = read_csv_table(spark, folder + "/out")
    assert "date_col_date" in again.columns and dict(again.dtypes)["value_outlier"] == "boolean"


def test_ids_are_given_out_once(spark, folder):
    table = folder + "/known"
    add_existing(table, spark.createDataFrame([(41, "old.csv")], "id bigint, original_filename string"))
    upload = Upload(1, "x.csv", "/nowhere/x", "csv")
    assert append_dataset(spark, table, upload, 1, 1) == 42
    # another writer has taken the next id but not written its row yet
    os.makedirs(table + "/ids", exist_ok=True)
    open(table + "/ids/43", "w").close()
    assert append_dataset(spark, table, upload, 1, 1) == 44
    assert sorted(r.id for r in read_datasets(spark, table).collect()) == [41, 42, 44]


def test_json_lines_round_trip(spark, folder):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "i bigint, s string, d double")
    write_table(df, folder + "/j", "json")
    back = read_json_records(spark, folder + "/j").drop(ROW_ID).select("i", "s", "d")
    assert sorted(map(tuple, back.collect())) == [(1, "a", None), (2, None, 2.5)]
    with pytest.raises(ValueError):
        write_table(df, folder + "/x", "xlsx")


def test_json_list_is_the_union_of_keys(spark, folder):
    path = put(folder, "l.json", '[{"a":1},\n{"a":2,"b":{"c":[1]}}]')
    rows = read_json_records(spark, path, multi_line=True).drop(ROW_ID).collect()
    assert [tuple(r) for r in rows] == [(1, None), (2, '{"c":[1]}')]


@pytest.mark.parametrize(
    "doc, want",
    [
        ({"a": [{"x": 1}, {"x": 2}, 5], "b": {"y": 3}, "c": 7}, [{"x": 1, "y": None, "_key": "a"}, {"x": 2, "y": None, "_key": "a"}, {"x": None, "y": 3, "_key": "b"}]),
        ({"a": 1, "b": "z"}, [{"a": 1, "b": "z"}]),
        ([{"a": 1}, {"a": 2, "b": 3}], [{"a": 1, "b": None}, {"a": 2, "b": 3}]),
        ({"k": [{"_key": "old", "v": 1.5}]}, [{"v": 1.5, "_key": "k"}]),
        ([1, 2, 3], [{"0": 1}, {"0": 2}, {"0": 3}]),
        (["x", None], [{"0": "x"}, {"0": None}]),
    ],
)
def test_json_document_shapes(spark, folder, doc, want):
    path = put(folder, "d.json", json.dumps(doc))
    got = [r.asDict() for r in read_json_documents(spark, path).drop(ROW_ID).collect()]
    order = lambda rows: sorted(rows, key=lambda r: json.dumps(r, sort_keys=True))
    assert order(got) == order(want)


def test_other_json_is_an_error(spark, folder):
    for name, text in (("s", "5"), ("t", '"text"'), ("m", '[{"a":1},2]'), ("n", "[[1],[2]]"), ("b", '{"a":')):
        with pytest.raises(Exception):
            read_json_documents(spark, put(folder, f"{name}.json", text)).collect()
    with pytest.raises(Exception, match="objects only"):
        read_json_records(spark, put(folder, "r.json", '[{"a":1},\n2]'), multi_line=True).collect()


def test_numbers_that_plain_json_has_not(spark, folder):
    path = put(folder, "n.json", '{"k": [{"a": NaN, "b": 1, "c": "NaN"}, {"a": 2.5, "b": Infinity, "c": "x"}, {"a": 1, "b": -Infinity}]}')
    rows = read_json_documents(spark, path).orderBy("b").select("a", "b", "c").collect()
    assert [tuple(r) for r in rows] == [(1.0, float("-inf"), None), (None, 1.0, "NaN"), (2.5, float("inf"), "x")]


def test_fields_of_reserved_and_like_names(spark, folder):
    rows = read_json_documents(spark, put(folder, "r.json", '[{"_row_id": 7, "a": 1}, {"_row_id": 8, "A": 2}]'))
    assert sorted(rows.columns) == ["A", "_row_id", "_row_id.1", "a.1"] and sorted(r["_row_id.1"] for r in rows.collect()) == [7, 8]
    lines = read_json_records(spark, put(folder, "l.json", '{"_row_id": 7}\n{"_row_id": 8}\n'))
    assert sorted(r["_row_id.1"] for r in lines.collect()) == [7, 8]


def test_integers_with_gaps_are_doubles(spark, folder):
    path = put(folder, "g.json", '{"a":1,"b":1}\n{"a":null,"b":2}\n')
    assert dict(read_json_records(spark, path).drop(ROW_ID).dtypes) == {"a": "double", "b": "bigint"}


def test_csv_fields_are_not_lost(spark, folder):
    def read(name, **files):
        os.makedirs(f"{folder}/{name}")
        for n, text in files.items():
            put(f"{folder}/{name}", f"{n}.csv", text)
        return read_csv_table(spark, f"{folder}/{name}").drop(ROW_ID)

    swapped = read("swapped", a="a,b\n1,x\n", b="b,a\ny,2\n", c="b,c\nz,3\n", d="a,b,c\n")
    assert sorted((r.a, r.b, r.c) for r in swapped.fillna(0).collect()) == [(0, "z", 3), (1, "x", 0), (2, "y", 0)]
    assert read("short", a='k,t\n1\n2,"a,\n""b"""\n').collect() == [(1, None), (2, 'a,\n"b"')]
    for i, text in enumerate(("k,t\n1,a,b\n", "k,t\n1,a\n2,a,\n", 'k,t\n"x,y",a,\n')):
        with pytest.raises(Exception, match="more fields"):
            read(f"long{i}", a=text, b="k,t\n1,2\n").collect()
        with pytest.raises(Exception, match="more fields"):
            read(f"mixed{i}", a=text, b="k,t,u\n1,2,3\n").collect()
    assert read("names", a="a,A,,a\n1,2,3,4\n").columns == ["a", "A.1", "Unnamed: 2", "a.2"]
    assert read("counted", a="a,b\n1,2\n").count() == 1
    assert read("none", a="a,b\n").dtypes == [("a", "string"), ("b", "string")]


def test_documents_in_a_column(spark):
    df = spark.createDataFrame([(1, '{"a":[{"x":1}],"b":2}'), (2, '[{"x":"t"}]')], "id int, doc string")
    assert sorted(map(tuple, flatten_keyed_json(df, "doc").collect())) == [(1, "1", "a"), (2, "t", None)]


def test_date_names(spark):
    df = spark.createDataFrame(
        [("2024-01-02", 1_700_000_000, 1_700_000_000_500, "x", "2024-01-02"), (None, 1_700_000_100, 1_700_000_100_000, "2024-01-02", "2024-01-03")],
        "created_at string, start_time bigint, timestamp_ms bigint, modified string, other string",
    )
    out = convert_named_dates(df)
    assert dict(out.dtypes) == {"created_at": "timestamp", "start_time": "timestamp", "timestamp_ms": "timestamp", "modified": "string", "other": "string"}
    first = out.select(F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"), F.date_format("timestamp_ms", "yyyy-MM-dd HH:mm:ss.SSS")).first()
    assert tuple(first) == ("2023-11-14 22:13:20", "2023-11-14 22:13:20.500")


def test_manifest(spark, folder):
    for name in ("a.CSV", "b.json", "c.txt", "noext"):
        put(folder, name, "x")
    got = {r["name"]: (r["ext"], r["accepted"]) for r in upload_manifest(spark, folder).collect()}
    assert got == {"a.CSV": ("csv", True), "b.json": ("json", True), "c.txt": ("txt", False), "noext": ("", False)}
    big = check_uploads(spark.createDataFrame([("a.csv", 60 * 1024 * 1024)], "name string, length bigint"), "name", "length").first()
    assert (big.accepted, big.reason) == (False, "File too large")


def test_empty_csv_has_text_columns(spark, folder):
    assert fit_types(spark.createDataFrame([], "a string"), ["a"]) == {"a": "string"}


def test_repeated_keys_are_refused_unless_the_session_takes_them(spark, tmp_path):
    (tmp_path / "twice.json").write_text('[{"a": 1, "a": 2, "b": "x"}, {"a": 3, "b": "y", "b": null}]')
    setting = "spark.sql.variant.allowDuplicateKeys"
    with pytest.raises(Exception):
        read_json_documents(spark, str(tmp_path)).collect()
    spark.conf.set(setting, "true")
    try:
        rows = read_json_documents(spark, str(tmp_path)).select("a", "b").collect()
    finally:
        spark.conf.unset(setting)
    assert sorted(map(tuple, rows)) == [(2, "x"), (3, None)]
