import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenset.operators import catalog as c, gallery as g
from test_plans import final_plan

SCHEMA = "viewer_id bigint, id bigint, created_at timestamp, title string"


def listing(n, seed=1):
    """Half of all rows of viewer 0, many equal times, some missing."""
    pick, start = random.Random(seed), datetime(2024, 1, 1)
    viewer = lambda: pick.choice([0, 0, 0, 1, 2, None])
    return [(viewer(), i, pick.choice([None, start + timedelta(hours=pick.randrange(n // 3))]), f"t{i}") for i in range(n)]


def test_pages_equal_those_by_sorting(spark, tmp_path):
    rows = listing(400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    stored = g.write_gallery(df, str(tmp_path))
    order = [F.desc_nulls_last("created_at"), F.desc("id")]
    for viewer in (0, 1, 9):
        mine = df.where(F.col("viewer_id") == viewer)
        assert g.gallery_total(stored, viewer) == mine.count()
        for number, size in ((-1, 6), (1, 6), (2, 6), (9, 20), (3, 100), (1, 1000), (500, 6)):
            got = [r.id for r in g.gallery_page_at(stored, viewer, number, size).collect()]
            assert got == [r.id for r in c.page(mine, order, number, size).collect()], (viewer, number, size)


def test_a_gallery_spans_files(spark, tmp_path):
    df = spark.createDataFrame([(5, i, datetime(2024, 1, 1) + timedelta(seconds=i), "t") for i in range(2000)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = g.write_gallery(df, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert stored.index().count() > 4
    everything = [r.id for n in range(1, 22) for r in g.gallery_page_at(stored, 5, n, 100).collect()]
    assert everything == list(range(1999, -1, -1))


def test_a_page_reads_its_places_only(spark, tmp_path):
    df = spark.createDataFrame(listing(300), SCHEMA)
    stored = g.write_gallery(df, str(tmp_path))
    text = final_plan(g.gallery_page_at(stored, 0, 12))
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(_place," in text and "LessThanOrEqual(_place," in text
    assert "TakeOrderedAndProject(limit=6" in text


def test_empty_galleries_and_reserved_names(spark, tmp_path):
    empty = g.write_gallery(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert g.gallery_page_at(empty, 0).count() == 0 and g.gallery_total(empty, 0) == 0
    odd = spark.createDataFrame([(0, 1, datetime(2024, 1, 1), 7, 8)], "`my viewer` bigint, `a.id` bigint, at timestamp, viewer bigint, part int")
    stored = g.write_gallery(odd, f"{tmp_path}/b", "my viewer", "at", "a.id")
    assert g.gallery_page_at(stored, 0).columns == odd.columns and g.gallery_page_at(stored, 0).count() == 1
    with pytest.raises(ValueError):
        g.write_gallery(odd.withColumn(g.PLACE, F.lit(1)), f"{tmp_path}/c")
