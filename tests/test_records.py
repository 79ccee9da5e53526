"""Records with quoted line breaks in files that are cut into very small blocks, against Python's reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from lumenset.session import ROW_ID
from lumenset.sources import csv as source
from lumenset.sources.csv import FILE, free_names, read_csv_table, read_csv_text
from lumenset.sources.records import OPEN_END, block_starts, ends_inside, file_lines, line_breaks

SMALL_BLOCKS = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "40"}


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_BLOCKS}
    for k, v in SMALL_BLOCKS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def put(folder, name, text):
    (folder / name).write_bytes(text.encode())
    return str(folder / name)


def values(seed, n):
    draw = random.Random(seed)
    some = ["plain", "two\nlines", "a,b", 'says "hi"', '"', '""', "\n", 'x"\n"y', "", "long " * 40, "break\n" * 9, ',"', "é\n日本", "end\r\nof"]
    return [[str(i), draw.choice(some), draw.choice(some)] for i in range(n)]


def written(rows, quoting=csv.QUOTE_MINIMAL, end="\n"):
    import io

    out = io.StringIO()
    csv.writer(out, quoting=quoting, lineterminator=end).writerows([["k", "a", "b"], *rows])
    return out.getvalue()


def got(df):
    return sorted((int(r.k), r.a, r.b) for r in df.collect())


def want(rows):
    return sorted((int(k), a or None, b or None) for k, a, b in rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_many_tasks_cut_the_records_of_a_file(spark, tmp_path, small_blocks, quoting, end):
    rows = [r for r in values(1, 150) if end == "\n" or "\r" not in r[1] + r[2]]
    path = put(tmp_path, "a.csv", written(rows, quoting, end))
    lines = file_lines(spark, path)
    assert line_breaks(lines) == (True, False, True)
    assert lines.select("block").distinct().count() > 20
    back = read_csv_text(spark, path)
    clean = [[k, a.replace("\r\n", "\n"), b.replace("\r\n", "\n")] for k, a, b in rows] if end == "\n" else rows
    found = sorted((int(r.k), *(x.replace("\r\n", "\n") if x else x for x in (r.a, r.b))) for r in back.collect())
    assert found == want(clean)
    # rows come in the order of the file
    assert [int(r.k) for r in back.orderBy(ROW_ID).collect()] == sorted(int(r[0]) for r in rows)


def test_values_over_many_blocks_and_over_whole_blocks(spark, tmp_path, small_blocks):
    rows = [["0", "line\n" * 200, "x"], ["1", "", 'q"\n' * 60], ["2", "short", "k,a,b"], ["3", '"\n"' * 100 + "k,a,b\n", "y\n"]]
    path = put(tmp_path, "a.csv", written(rows))
    assert got(read_csv_text(spark, path)) == want(rows)


def test_several_files_headers_like_rows_and_short_records(spark, tmp_path, small_blocks):
    first, second = values(2, 40), [[str(1000 + i), a, b] for i, (_, a, b) in enumerate(values(3, 40))]
    put(tmp_path, "a.csv", "k,a,b\n" + written(first))
    put(tmp_path, "b.csv", "\n\nb,k\n" + "".join(f'"{b.replace(chr(34), chr(34) * 2)}",{k}\n\n' for k, _, b in second))
    put(tmp_path, "c.csv", "k,a,b\n7,x\n")
    found = [(r.k, r.a, r.b) for r in read_csv_text(spark, str(tmp_path)).collect()]
    clean = lambda x: x or None
    expected = [("k", "a", "b"), ("7", "x", None)] + [(k, clean(a), clean(b)) for k, a, b in first] + [(k, None, clean(b)) for k, _, b in second]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_too_many_fields_and_open_values_are_errors(spark, tmp_path, small_blocks):
    with pytest.raises(Exception, match="more fields"):
        read_csv_text(spark, put(tmp_path, "long.csv", written(values(4, 30)) + '8,"x\ny",2,3\n')).collect()
    with pytest.raises(ValueError, match=OPEN_END):
        read_csv_text(spark, put(tmp_path, "open.csv", written(values(5, 30)) + '8,"x\ny\n')).collect()


def test_types_are_found_in_split_records(spark, tmp_path, small_blocks):
    path = put(tmp_path, "a.csv", "i,d,t\n" + "".join(f'{i},{i}.5,"a\n{i}"\n' for i in range(60)))
    table = read_csv_table(spark, path)
    assert table.drop(ROW_ID).dtypes == [("i", "bigint"), ("d", "double"), ("t", "string")]
    assert table.agg(F.sum("i"), F.sum("d"), F.count("t")).first() == (1770, 1800.0, 60)


def test_files_without_breaks_are_read_line_by_line(spark, tmp_path, small_blocks, monkeypatch):
    rows = [[k, a.replace("\n", " ").replace("\r", ""), b.replace("\n", " ").replace("\r", "")] for k, a, b in values(6, 80)]
    asked = []
    read = source.read_csv_fields
    monkeypatch.setattr(source, "read_csv_fields", lambda *args: asked.append(args[3]) or read(*args))
    found = got(read_csv_text(spark, put(tmp_path, "a.csv", written(rows))))
    assert asked == [False]
    assert [(k, (a or "").strip(), (b or "").strip()) for k, a, b in found] == [(k, (a or "").strip(), (b or "").strip()) for k, a, b in want(rows)]


def test_carriage_returns_are_left_to_the_reader(spark, tmp_path, small_blocks):
    """It makes line feeds of them inside values, too."""
    assert got(read_csv_text(spark, put(tmp_path, "a.csv", 'k,a,b\r1,x,"y\rz"\r2,u,v\r'))) == [(1, "x", "y\nz"), (2, "u", "v")]


def state_by_hand(text, inside):
    """One character after the other."""
    state = "in" if inside else "start"
    for place, c in enumerate(text):
        if state == "in":
            state = "quote" if c == '"' else "in"
        elif state == "quote":
            state = "in" if c == '"' else "start" if c == "," else "text"
        elif c == ",":
            state = "start"
        elif c == '"' and state == "start":
            state = "in"
        else:
            state = "text"
    return int(state == "in")


def test_state_of_lines(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choice('"",x') for _ in range(draw.randrange(9))) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "line string")
    for r in frame.select("line", ends_inside(F.col("line"), False).alias("a"), ends_inside(F.col("line"), True).alias("b")).collect():
        assert (r.a, r.b) == (state_by_hand(r.line, False), state_by_hand(r.line, True)), r.line


def test_lines_stay_in_the_task_that_reads_them(spark, tmp_path, small_blocks, capfd):
    """Neither lines nor records are put in order or dealt by their file: such a task would hold a whole block or file."""
    read_csv_text(spark, put(tmp_path, "a.csv", written(values(11, 60)))).explain()
    plan = capfd.readouterr().out
    assert "from_csv" in plan and "MapInArrow" in plan
    assert not any(step in plan for step in ("Window", "SortMergeJoin", "Sort ["))


def test_first_lines_are_found_without_putting_lines_in_order(spark, tmp_path, small_blocks, monkeypatch):
    put(tmp_path, "a.csv", "\n\nk,a\n" + "1,x\n" * 200)
    put(tmp_path, "b.csv", "b,k\n2,y\n")
    put(tmp_path, "c.csv", "\n")
    plans, real = [], type(spark.range(1)).collect

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(type(spark.range(1)), "collect", seen)
    found = source.first_lines(spark, str(tmp_path))
    assert {f.rsplit("/", 1)[1]: line for f, line in found.items()} == {"a.csv": "k,a", "b.csv": "b,k"}
    assert plans and not any("SortAggregate" in p for p in plans)


def test_states_of_blocks(spark):
    """Blocks of lines of all kinds, against the states of one line after the other."""
    draw = random.Random(10)
    lines, states = [], {}
    state = 0
    for block in range(60):
        states[block * 10] = state
        for i in range(draw.randrange(1, 5)):
            text = draw.choice(["x", "", '"', 'a,"b', '"a","b"', 'x"', '""', ',"a', 'a"b,"c', '"'])
            lines.append(("f", block * 10, block * 100 + i, text))
            state = state_by_hand(text, state == 1)
    frame = spark.createDataFrame(lines, "file string, block long, id long, line string").repartition(5)
    assert {r.block: r.start for r in block_starts(frame).collect()} == states


def test_names_are_numbered_until_free():
    assert free_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]
    assert free_names(["a", "A", "b", "a"]) == ["a", "A.1", "b", "a.2"]
    assert free_names(["_row_id", "_row_id.1", "_ROW_ID"]) == ["_row_id.2", "_row_id.1", "_ROW_ID.3"]


def test_reserved_and_repeated_names_lose_nothing(spark, tmp_path):
    read = lambda text: read_csv_table(spark, put(tmp_path, "n.csv", text)).drop(ROW_ID)
    assert read("a,a,a.1\n1,2,3\n").collect()[0].asDict() == {"a": 1, "a.2": 2, "a.1": 3}
    assert read("_row_id,b\n77,2\n").collect()[0].asDict() == {"_row_id.1": 77, "b": 2}
    assert read("_file,_bad_record,file,id,block,record,bad,c0\n1,2,3,4,5,6,7,8\n").collect() == [(1, 2, 3, 4, 5, 6, 7, 8)]
    assert FILE not in read("_file\n1\n").columns
