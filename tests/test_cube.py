from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenset.operators import cube as cb, feeds as f
from test_plans import plan

ROWS = [
    ("a", "x", 1, 10.0, datetime(2024, 1, 5)),
    ("a", None, 2, 20.0, datetime(2024, 1, 31)),
    ("b", "y", None, float("nan"), datetime(2024, 2, 1)),
    (None, "y", 4, 5.0, datetime(2024, 2, 29)),
    ("b", "x", 5, -7.5, None),
    ("c", "z", 6, 0.0, datetime(2024, 3, 1)),
    ("a", "x", 1, 10.0, datetime(2024, 1, 5)),
]
SCHEMA = "`kind.of` string, side string, n bigint, price double, at timestamp"
MONTHS = {"month": (datetime(2024, 1, 1), datetime(2024, 2, 1))}
SIDES = {"side": ["x", "y"]}


def same(got, want):
    clean = lambda df: sorted(str(tuple(r)) for r in df.select(sorted(df.columns)).collect())
    assert got.columns == want.columns
    assert clean(got) == clean(want)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def cube(rows, tmp_path_factory):
    return cb.build_cube(rows, ["kind.of", "side"], ["n", "price"], str(tmp_path_factory.mktemp("cube")), {"month": ("at", "month")})


@pytest.mark.parametrize("isin, between", [(None, None), (SIDES, None), (None, MONTHS), (SIDES, MONTHS), ({"side": ["none"]}, None), ({"kind.of": ["a"]}, {"month": (None, MONTHS["month"][1])})])
def test_feeds_equal_those_from_the_rows(rows, cube, isin, between):
    # whole months of the cube are times up to the end of the month
    ends = {"at": (between["month"][0], datetime(2024, 2, 29, 23, 59, 59))} if between else None
    left = f.apply_filters(rows, isin, ends)
    same(cb.kpis_of(cube, isin, between), f.kpis(left, ["n", "price"]))
    same(cb.by_category_of(cube, "kind.of", "price", 1, isin, between), f.by_category(left, "kind.of", "price", 1))
    same(cb.by_time_of(cube, "month", "price", isin, between), f.by_time(left, "at", "month", "price"))
    same(cb.by_two_of(cube, "side", "kind.of", "n", isin, between), f.by_two(left, "side", "kind.of", "n"))


def test_a_question_reads_its_cuboid_and_not_the_rows(cube):
    text = plan(cb.by_two_of(cube, "side", "month", "price"))
    assert "= c011)" in text and text.count("FileScan") == 1
    assert cube.cuboid(["side"]).count() == 4 and cube.cuboid([]).count() == 1


def test_rows_are_scanned_once_to_build_it(rows, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(cb, "cut_lineage", lambda df: seen.append(df) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    cb.build_cube(rows, ["side"], ["n"], str(tmp_path))
    assert len(seen) == 1 and plan(seen[0]).split("== Initial Plan ==")[0].count("Scan") == 1


def test_many_dimensions_keep_the_finest_cells(spark, tmp_path):
    wide = spark.createDataFrame([tuple(range(8)), tuple(range(8, 16))], ", ".join(f"c{i} int" for i in range(8)))
    cube = cb.build_cube(wide, [f"c{i}" for i in range(7)], ["c7"], str(tmp_path))
    assert cube.cuboid(["c0"]).count() == 2
    same(cb.by_category_of(cube, "c3", "c7", 5, {"c0": [0]}), f.by_category(wide.where("c0 = 0"), "c3", "c7", 5))


def test_empty_table_replaces_an_earlier_cube(rows, tmp_path):
    cb.build_cube(rows, ["side"], ["n"], str(tmp_path))
    empty = rows.limit(0)
    cube = cb.build_cube(empty, ["side"], ["n"], str(tmp_path))
    same(cb.kpis_of(cube), f.kpis(empty, ["n"]))
    same(cb.by_category_of(cube, "side", "n"), f.by_category(empty, "side", "n"))


def test_what_a_cube_cannot_tell_is_refused(rows, cube, tmp_path):
    for ask in (
        lambda: cb.kpis_of(cube, between={"month": (datetime(2024, 1, 5), None)}),
        lambda: cb.kpis_of(cube, {"price": [1.0]}),
        lambda: cb.by_category_of(cube, "side", "at"),
        lambda: cb.build_cube(rows, [], ["n"], str(tmp_path)),
        lambda: cb.build_cube(rows, ["side"], ["n"], str(tmp_path), {"side": ("at", "month")}),
    ):
        with pytest.raises(ValueError):
            ask()
