from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenset.operators import access, catalog as c, lifecycle


@pytest.fixture(scope="module")
def cat(spark):
    """Users 1 to 4; 1 owns datasets 10 (private) and 11 (public), 2 owns 20 (private); owner 9 is unknown."""
    at = lambda day: datetime(2024, 1, day)
    users = spark.createDataFrame(
        [(i, n, e, "h", at(1)) for i, n, e in [(1, "Cy", "a@x"), (2, "Bo", "b@x"), (3, "Al", "b@x"), (4, "Di", "d@x")]], c.USER_SCHEMA
    )
    datasets = spark.createDataFrame(
        [
            (10, 1, "f", "ten.csv", "p", "csv", 5, 2, False, at(2)),
            (11, 1, "f", "eleven.csv", "p", "csv", 5, 2, True, at(3)),
            (20, 2, "f", "twenty.json", "p", "json", 5, 2, False, at(3)),
            (90, 9, "f", "ninety.csv", "p", "csv", 5, 2, False, at(4)),
        ],
        c.DATASET_SCHEMA,
    )
    visualisations = spark.createDataFrame(
        [(100, 10, "t", None, "s", at(5)), (101, 10, "t", None, "s", at(6)), (110, 11, "t", None, "s", at(5)), (200, 20, "t", None, "s", at(7))],
        c.VISUALISATION_SCHEMA,
    )
    shares = spark.createDataFrame(
        [
            (1, 1, 3, "dataset", 10, at(8)),
            (2, 1, 3, "dataset", 10, at(9)),
            (3, 1, 2, "visualisation", 100, at(8)),
            (4, 9, 3, "dataset", 90, at(8)),
            (5, 2, 3, "visualisation", 777, at(8)),
            (6, 1, 4, "dataset", 11, at(8)),
        ],
        c.SHARE_SCHEMA,
    )
    return c.Catalog(users, datasets, visualisations, shares)


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_listings_are_newest_first(cat):
    assert ids(c.datasets_owned(cat, 1)) == [11, 10]
    assert ids(c.visualisations_owned(cat, 1)) == [101, 110, 100]
    assert ids(c.dataset_visualisations(cat, 10)) == [101, 100]


def test_shared_datasets_once_and_without_owner(cat):
    got = [(r.id, r.owner) for r in c.datasets_shared_with(cat, 3).collect()]
    assert got == [(90, "Unknown"), (10, "Cy")]


def test_public_listing_leaves_out_own_and_shared(cat):
    assert ids(c.datasets_public(cat, 2)) == [11]
    assert ids(c.datasets_public(cat, 1)) == [] and ids(c.datasets_public(cat, 4)) == []


def test_users_to_share_with(cat):
    assert ids(c.shareable_users(cat, 1, 100)) == [3, 4]
    assert sorted(ids(c.shared_with(cat, c.DATASET, 1, 10), "target_id")) == [3]
    assert sorted(ids(c.other_users(cat, 1))) == [2, 3, 4]


def test_counts_include_users_without_datasets(cat):
    got = {r.user_id: (r.n_datasets, r.n_visualisations) for r in c.user_counts(cat).collect()}
    assert got == {1: (2, 3), 2: (1, 1), 3: (0, 0), 4: (0, 0)}


def test_pages(cat):
    mine = c.visualisations_owned(cat, 1)
    order = [F.desc("created_at"), F.desc("id")]
    assert [len(c.page(mine, order, n, 2).collect()) for n in (-1, 1, 2, 3)] == [2, 2, 1, 0]
    assert c.page_info(mine, 2, 2).first() == (2, 3, 2, True, False)


def check(cat, job, pairs):
    requests = cat.users.sparkSession.createDataFrame(pairs, "user_id bigint, object_id bigint")
    return {(r.user_id, r.object_id): r.reason for r in job(cat, requests).collect()}


def test_dataset_access(cat):
    got = check(cat, access.can_view_dataset, [(1, 10), (2, 10), (3, 10), (2, 11), (4, 11), (1, 999), (3, 777)])
    assert got == {(1, 10): "owner", (2, 10): None, (3, 10): "shared", (2, 11): "public", (4, 11): "public", (1, 999): None, (3, 777): None}


def test_dashboard_access_needs_its_own_share(cat):
    got = check(cat, access.can_view_visualisation, [(3, 100), (2, 100), (1, 100), (4, 110), (3, 777)])
    assert got == {(3, 100): None, (2, 100): "shared", (1, 100): "owner", (4, 110): "public", (3, 777): None}


def test_access_table_agrees_with_requests(cat):
    table = {(r.user_id, r.dataset_id): r.reason for r in access.dataset_access(cat).collect()}
    assert table == {
        (1, 10): "owner", (1, 11): "owner", (2, 20): "owner", (9, 90): "owner", (None, 11): "public",
        (3, 10): "shared", (3, 90): "shared", (4, 11): "public",
    }


def test_grant_is_idempotent_and_revoke_undoes_it(cat, spark):
    new = spark.createDataFrame([(1, 2, "dataset", 10)] * 2 + [(1, 3, "dataset", 10)], "owner_id bigint, target_id bigint, object_type string, object_id bigint")
    once = lifecycle.grant(cat.shares, new)
    assert once.count() == 7 and lifecycle.grant(once, new).count() == 7
    assert lifecycle.revoke(once, new).count() == 4


def test_deletes(cat, spark):
    gone = lambda *ids_: spark.createDataFrame([(i,) for i in ids_], "id bigint")
    boards = lifecycle.delete_visualisations(cat, gone(100))
    assert sorted(ids(boards.visualisations)) == [101, 110, 200] and boards.shares.count() == 5
    sets = lifecycle.delete_datasets(cat, gone(10))
    assert sorted(ids(sets.visualisations)) == [110, 200] and sets.shares.count() == 6
    users = lifecycle.delete_users(cat, gone(1))
    assert sorted(ids(users.datasets)) == [20, 90] and ids(users.visualisations) == [200]
    assert sorted(ids(users.shares)) == [4, 5] and sorted(ids(users.users)) == [2, 3, 4]
    issues = {(r.issue, r.object_id, r.detail, r.n) for r in lifecycle.integrity_report(sets).collect()}
    assert issues == {
        ("orphaned share", 777, None, 1), ("orphaned share", 10, None, 2), ("orphaned share", 100, None, 1),
        ("repeated share", 10, "1->3", 2), ("repeated e-mail", None, "b@x", 2),
    }


def test_toggle_and_list(cat, spark):
    flipped = lifecycle.toggle_public(cat.datasets, spark.createDataFrame([(10,), (11,), (11,)], "id bigint"))
    assert {r.id: r.is_public for r in flipped.collect()} == {10: True, 11: False, 20: False, 90: False}
    row = c.listing(cat.datasets).where("id = 11").first()
    assert (row.file_type, row.visibility, row.uploaded_at, row.day, row.minute) == (
        "CSV", "Public", "2024-01-03T00:00:00", "Jan 03, 2024", "Jan 03, 2024 00:00"
    )


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_requests_meet_shares_in_one_aggregate(cat, spark, capsys):
    asked = [(3, 10), (3, 10), (4, 11), (1, 10), (2, 10), (3, 12), (None, 10), (3, None), (None, 11)]
    given = [(7, 1, None, "dataset", 10, None), (8, 1, 3, "dataset", None, None)]
    with_nulls = cat.replace(shares=cat.shares.unionByName(spark.createDataFrame(given, c.SHARE_SCHEMA)))
    checked = access.can_view_dataset(with_nulls, spark.createDataFrame(asked, "user_id bigint, object_id bigint"))
    # the objects are joined, shares are not
    assert plan_of(checked, capsys).count("Join") == 1
    assert sorted(((r.user_id or 0, r.object_id or 0), r.allowed, r.reason) for r in checked.collect()) == [
        ((0, 10), False, None), ((0, 11), True, "public"), ((1, 10), True, "owner"), ((2, 10), False, None),
        ((3, 0), False, None), ((3, 10), True, "shared"), ((3, 12), False, None), ((4, 11), True, "public"),
    ]


def test_repeated_shares_are_not_held_by_the_tasks_that_read_them(cat, spark, capsys):
    more = [(7, None, 3, "dataset", 10, None), (8, None, 3, "dataset", 10, None), (9, 1, 3, "dataset", 10, None)]
    report = lifecycle.integrity_report(cat.replace(shares=cat.shares.unionByName(spark.createDataFrame(more, c.SHARE_SCHEMA))))
    lines = plan_of(report, capsys).splitlines()
    assert not any("Aggregate" in line and "target_id" in line for line in lines)
    repeated = {(r.object_type, r.object_id, r.detail, r.n) for r in report.collect() if r.issue == "repeated share"}
    assert repeated == {("dataset", 10, "1->3", 3), ("dataset", 10, "3", 2)}
