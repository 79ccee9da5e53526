import random

from pyspark.sql import functions as F

from lumenset.operators import access, catalog as c, joins, lifecycle, reasons as r

DATASETS = "id bigint, user_id bigint, is_public boolean"
BOARDS = "id bigint, dataset_id bigint"
SHARES = "owner_id bigint, target_id bigint, object_type string, object_id bigint"


def tables(spark, seed):
    pick = random.Random(seed)
    users = spark.createDataFrame([(i,) for i in range(6)], "id bigint")
    datasets = spark.createDataFrame([(10 + i, pick.choice([*range(6), None]), pick.choice([True, False, None])) for i in range(8)], DATASETS)
    boards = spark.createDataFrame([(100 + i, 10 + pick.randrange(9)) for i in range(12)], BOARDS)
    shares = [(pick.choice([0, 1, 2, 3, 4, 5, None]), pick.randrange(6), *pick.choice([("dataset", 10 + pick.randrange(10)), ("visualisation", 100 + pick.randrange(14))])) for _ in range(40)]
    return c.Catalog(users, datasets, boards, spark.createDataFrame(shares + shares[:5], SHARES))


def settled(cat):
    """The same catalog without the history of its tables."""
    again = lambda t: t.sparkSession.createDataFrame(t.coalesce(1).collect(), t.schema)
    return c.Catalog(*[again(t) for t in (cat.users, cat.datasets, cat.visualisations, cat.shares)])


def recount(cat):
    both = [(c.DATASET, access.dataset_access(cat)), (c.VISUALISATION, access.visualisation_access(cat))]
    return sorted((kind, str(x[0]), x[1], x[2], bool(x[3])) for kind, df in both for x in df.collect())


def kept(now):
    return sorted((kind, str(x[0]), x[1], x[2], bool(x[3])) for kind in (c.DATASET, c.VISUALISATION) for x in r.rights(now, kind).collect())


def stored(spark, path, change, batch):
    """The change is stored twice, as after a failure."""
    for _ in range(2):
        r.add_batch(change(r.read_batches(spark, path, batch) if batch else None), path, batch)
    return r.read_reasons(spark, path)


def test_changes_equal_a_recount(spark, tmp_path):
    path, cat = str(tmp_path), tables(spark, 1)
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "id bigint")
    assert kept(stored(spark, path, lambda _: r.all_reasons(cat), 0)) == recount(cat)

    new = spark.createDataFrame([(1, 2, "dataset", 12), (1, 2, "dataset", 12), (0, 3, "visualisation", 101), (2, 2, "dataset", 777)], SHARES)
    cat = settled(cat.replace(shares=lifecycle.grant(cat.shares, new)))
    assert kept(stored(spark, path, lambda now: r.granted(now, new), 1)) == recount(cat)

    gone = cat.shares.where("target_id in (1, 2) and object_id % 2 = 0")
    now = stored(spark, path, lambda now: r.revoked(now, gone), 2)
    cat = settled(cat.replace(shares=lifecycle.revoke(cat.shares, gone)))
    assert kept(now) == recount(cat)

    known = cat.datasets.where("is_public is not null").select("id")
    cat = settled(cat.replace(datasets=lifecycle.toggle_public(cat.datasets, known.unionByName(known))))
    assert kept(stored(spark, path, lambda now: r.flipped(now, known.unionByName(known)), 3)) == recount(cat)

    boards = ids(100, 103, 100, 999, None)
    cat = settled(lifecycle.delete_visualisations(cat, boards))
    assert kept(stored(spark, path, lambda now: r.without_visualisations(now, boards), 4)) == recount(cat)

    cat = settled(lifecycle.delete_datasets(cat, ids(11, 15)))
    assert kept(stored(spark, path, lambda now: r.without_datasets(now, ids(11, 15)), 5)) == recount(cat)

    cat = settled(lifecycle.delete_users(cat, ids(2, 4)))
    assert kept(stored(spark, path, lambda now: r.without_users(now, ids(2, 4)), 6)) == recount(cat)

    # a dataset and its dashboard arrive; shares given before they did count now
    more = spark.createDataFrame([(19, 0, True)], DATASETS), spark.createDataFrame([(113, 19)], BOARDS)
    cat = cat.replace(datasets=cat.datasets.unionByName(more[0]), visualisations=cat.visualisations.unionByName(more[1]))
    stored(spark, path, lambda now: r.added_datasets(more[0]), 7)
    now = stored(spark, path, lambda now: r.added_visualisations(now, more[1]), 8)
    assert kept(now) == recount(cat)

    r.compact(spark, path, f"{tmp_path}-one")
    assert kept(r.read_reasons(spark, f"{tmp_path}-one")) == recount(cat)


def test_reasons_that_cancel_out_leave_no_rows(spark, tmp_path):
    cat, path = tables(spark, 3), str(tmp_path)
    stored(spark, path, lambda _: r.all_reasons(cat), 0)
    everything = cat.datasets.select("id")
    stored(spark, path, lambda now: r.flipped(now, everything), 1)
    now = stored(spark, path, lambda now: r.flipped(now, everything), 2)
    # a missing flag counts as not public
    assert sorted(map(str, now.collect())) == sorted(map(str, r.merged(r.all_reasons(cat)).collect()))
    for batch, change in ((3, lambda now: r.without_datasets(now, everything)), (4, lambda now: r.without_visualisations(now, cat.shares.select(F.col("object_id").alias("id")))),
                          (5, lambda now: r.revoked(now, cat.shares))):
        now = stored(spark, path, change, batch)
    # shares without a granter match no key
    assert now.where("granter_id is not null").count() == 0 and now.where("reason <> 'shared'").count() == 0


def test_empty_catalog(spark, tmp_path):
    full = tables(spark, 4)
    cat = c.Catalog(*[t.limit(0) for t in (full.users, full.datasets, full.visualisations, full.shares)])
    now = stored(spark, str(tmp_path), lambda _: r.all_reasons(cat), 0)
    assert kept(now) == []
    assert kept(stored(spark, str(tmp_path), lambda now: r.without_users(now, full.users), 1)) == []


def changes(spark, now, cat):
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "id bigint")
    new = [(1, 2, "dataset", 12), (1, 2, "dataset", 12), (None, 2, "dataset", 12), (None, 2, "dataset", 12), (1, 2, "visualisation", 12), (2, 2, "dataset", 2**62)]
    return [
        r.granted(now, spark.createDataFrame(new, SHARES).unionByName(cat.shares.where("object_id % 2 = 0"))),
        r.revoked(now, cat.shares.where("target_id in (1, 2)").unionByName(cat.shares.where("target_id = 1"))),
        r.flipped(now, ids(10, 11, 11, 12, None, -1)),
        r.without_visualisations(now, ids(100, 103, 100, 999, None)),
        r.without_datasets(now, ids(11, 15, None)),
        r.without_users(now, ids(2, 4, 4, None)),
    ]


def test_reasons_that_a_change_does_not_touch_are_not_shuffled(spark, tmp_path):
    cat = tables(spark, 5)
    r.add_batch(r.all_reasons(cat), str(tmp_path), 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the ids were many
    try:
        for change in changes(spark, r.read_batches(spark, str(tmp_path)), cat):
            text = change._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
            # rows are dealt once; other exchanges deal the bitmaps of ids
            assert len([x for x in text.splitlines() if "Exchange hashpartitioning(" in x and "hashpartitioning(_grouping" not in x]) == 1
            assert "partial_bitmap_construct_agg" in text and "hashpartitioning(_bucket" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_changes_by_bitmaps_and_by_shuffles_agree(spark, tmp_path, monkeypatch):
    cat = tables(spark, 6)
    r.add_batch(r.all_reasons(cat), str(tmp_path), 0)
    rows = lambda: [sorted(map(str, change.collect())) for change in changes(spark, r.read_batches(spark, str(tmp_path)), cat)]
    by_bitmaps = rows()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert rows() == by_bitmaps and all(by_bitmaps)


def test_ids_far_apart_and_at_the_edges(spark):
    edges = [0, 1, -1, 7, 8, 9, 32767, 32768, 32769, -32767, -32768, -32769, 65536, 2**40, 2**63 - 1, -(2**63), 5]
    rows = spark.createDataFrame([(v,) for v in [*edges, *edges, None]], "x bigint")
    for chosen in (edges[::2], edges[1::2], []):
        ids = spark.createDataFrame([(v,) for v in [*chosen, *chosen, None]], "id bigint")
        for limit in (None, 0):
            assert sorted(x for x, in joins.among(rows, "x", ids, broadcast_bytes=limit).collect()) == sorted(chosen * 2)
            left = [x for x, in joins.among(rows, "x", ids, "left_anti", limit).collect()]
            assert sorted(str(x) for x in left) == sorted(str(x) for x in [*edges, *edges, None] if x not in chosen)
