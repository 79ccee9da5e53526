"""What the physical plans must and must not contain."""

import contextlib
import io
import re

import pytest

from lumenset.operators import feeds, profile
from lumenset.operators.clean import fit_clean
from lumenset.operators.markup import audit_html, repair_html
from lumenset.operators import quality
from lumenset.operators.clean_by import clean_by
from lumenset.plans import all_queries, sources
from lumenset.plans.tables import read

SMALL = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def final_plan(df):
    df.collect()
    return plan(df)


@pytest.mark.parametrize("name", list(all_queries()))
def test_no_cross_join_and_no_python_rows(spark, name):
    text = plan(all_queries()[name](spark, SMALL))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|MapInPandas", text)


def test_cleaning_a_fitted_table_is_one_narrow_scan(spark):
    events = read(spark, SMALL, "events").select("event_id", "value", "event_type")
    text = plan(fit_clean(events, "event_id").transform(events))
    assert "Exchange" not in text and text.count("FileScan") == 1
    assert "user_id" not in text and "props" not in text


def test_filters_and_columns_reach_the_scan(spark):
    chosen = feeds.apply_filters(read(spark, SMALL, "orders"), {"o_orderstatus": ["O", "F"]}, {"o_totalprice": (1000.0, None)})
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        feeds.kpis(chosen, ["o_totalprice"]).explain("formatted")
    text = out.getvalue()
    assert "In(o_orderstatus, [F,O])" in text and "GreaterThanOrEqual(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in text


def test_value_counts_are_computed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(profile, "cut_lineage", lambda df: seen.append(df) or df)
    orders = read(spark, SMALL, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    profile._shown_values(orders, ["o_orderstatus", "o_orderpriority"], "o_orderkey", 10, 3)
    text = final_plan(seen[0]).split("== Initial Plan ==")[0]
    assert text.count("FileScan") == 1 and "WindowGroupLimit" in text


def test_leaders_and_sums_share_one_aggregate(spark):
    lines = read(spark, SMALL, "lineitem")
    text = final_plan(feeds.by_category(lines, "l_returnflag", "l_quantity", 2)).split("== Initial Plan ==")[0]
    assert text.count("FileScan") == 1


def test_page_jobs_are_narrow(spark):
    pages = read(spark, SMALL, "pages")
    assert "Exchange" not in plan(audit_html(pages, "html")) + plan(repair_html(pages, "html"))


def test_first_rows_keep_only_the_first(spark):
    # without a key the scan stops with the rows it needs
    orders = read(spark, SMALL, "orders")
    for df in (profile.preview(orders), profile.excerpt(orders)):
        assert not re.search(r"Sort|TakeOrdered|Exchange RoundRobin|rangepartitioning", plan(df))
    assert "TakeOrderedAndProject" in plan(profile.preview(read(spark, SMALL, "orders"), 10, "o_orderkey"))
    assert "TakeOrderedAndProject" in plan(feeds.scatter(read(spark, SMALL, "orders"), "o_custkey", "o_totalprice", "o_orderkey", 5))


def _exchanges(text):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", text)


def test_repeated_rows_are_counted_by_their_keys(spark, monkeypatch):
    """No column of the table is shuffled, broadcast or not."""
    seen = []
    orders = read(spark, SMALL, "orders")
    grouped = type(orders).groupBy
    monkeypatch.setattr(type(orders), "groupBy", lambda self, *keys: seen.append((self.columns, keys)) or grouped(self, *keys))
    quality.duplicate_rows(orders)
    assert seen[0] == (["_key1", "_key2"], ("_key1", "_key2"))


def test_groups_are_cleaned_without_shuffling_their_rows(spark, monkeypatch):
    """Statistics are aggregates of the numbers, which alone are shuffled; only texts are counted by value."""
    from lumenset.operators import clean_by as module

    made = []
    monkeypatch.setattr(module, "cut_lineage", lambda df: made.append(plan(df)) or df)
    lines = read(spark, SMALL, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    text = plan(clean_by(lines, "l_suppkey"))
    assert made and not any(re.search("Expand|Generate|Window", t) for t in [*made, text])
    assert "SortMergeJoin" not in text.split("FileScan")[0] or "BroadcastHashJoin" in text


def test_a_fit_keeps_no_copy_of_the_table(spark):
    events = read(spark, SMALL, "events")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    fit_clean(events, "event_id", direct_rows=100)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_documents_of_plain_values_have_bounded_size(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(sources, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    sources.json_mixed_list(spark, sf_dir)
    documents = spark.read.option("wholetext", True).text(f"{tmp_path}/documents")
    lengths = [r[0] for r in documents.selectExpr("size(from_json(value, 'array<bigint>'))").collect()]
    assert sum(lengths) == read(spark, sf_dir, "orders").count() and max(lengths) <= 1000
