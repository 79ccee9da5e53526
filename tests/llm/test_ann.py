import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from lumenset.llm import ann
from lumenset.plans.tables import read

KINDS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())]
)


def table(spark, vectors, extra=()):
    rows = [(i, None if v is None else [float(x) for x in v], "clash") for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, KINDS).repartition(3)


def recall(found, ids, vectors, queries, k=20):
    want = ann.nearest_by_brute_force(ids, vectors, queries, k)
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for query, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[query]) + 1))
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        exact = dict(want[query])
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in rows if i in exact)
        hits += len({i for _, i, _ in rows} & set(exact))
    return hits / sum(map(len, want.values()))


def test_recall_on_the_given_vectors(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    found = ann.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    rows = vectors.toPandas()
    ids = rows.vec_id.to_numpy()
    assert recall(found, ids, np.array(rows.embedding.tolist()).astype(float), ids[ids % 20 == 0]) >= 0.9


def test_lengths_that_differ_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "ROWS_PER_LIST", 100)
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((12, 24))
    vectors = np.float32((centres[draw.integers(0, 12, 1500)] + 0.3 * draw.standard_normal((1500, 24))) * draw.uniform(0.2, 3, (1500, 1)))
    df = table(spark, vectors)
    found = ann.nearest_neighbours(df, df.filter("vec_id % 20 = 0"), probes=0.5).collect()
    assert recall(found, np.arange(1500), vectors.astype(float), np.arange(0, 1500, 20)) >= 0.9


def test_equal_vectors_tie_by_id(spark):
    vectors = np.float32([[1, 0, 0]] * 30 + [[0.5, 0.1, 0]] * 5)
    df = table(spark, vectors)
    found = ann.nearest_neighbours(df, df.filter("vec_id in (3, 33)"), k=20).collect()
    by_query = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (3, 33)}
    assert by_query == {3: [i for i in range(21) if i != 3], 33: list(range(20))}


def test_few_candidates_and_invalid_vectors(spark):
    vectors = [[1, 2], [2, 1], None, [], [0, 0], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], [-1, -1]]
    extra = [(None, [1.0, 1.0], "x"), (20, [None, 1.0], "x"), (0, [1.0, 2.0], "repeated")]
    df = table(spark, vectors, extra)
    found = ann.nearest_neighbours(df, df).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [
        (0, 1, 1, 4.0), (0, 2, 8, -3.0), (1, 1, 0, 4.0), (1, 2, 8, -3.0), (8, 1, 0, -3.0), (8, 2, 1, -3.0)
    ]
    none = df.filter("vec_id = -5")
    assert ann.nearest_neighbours(none, none).collect() == []
    assert ann.nearest_neighbours(df, none).collect() == []


def test_scan_finds_the_nearest():
    draw = np.random.default_rng(1)
    candidates, queries = draw.standard_normal((3000, 65)), draw.standard_normal((20, 65))
    for number, places in ann.adaptive_scan(queries, candidates, 10):
        exact = ((candidates - queries[number]) ** 2).sum(axis=1)
        assert len(set(np.argsort(exact)[:10]) & set(places)) >= 9


@pytest.mark.parametrize("dims", [2, 65])
def test_rotation_keeps_products(dims):
    turn = ann.rotation(dims)
    assert np.allclose(turn @ turn.T, np.eye(dims))
    vectors = np.random.default_rng(2).standard_normal((50, dims - 1))
    long = ann.lengthened(vectors, np.sqrt((vectors**2).sum(axis=1).max()))
    assert np.allclose((long**2).sum(axis=1), (vectors**2).sum(axis=1).max())


def test_query_columns(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").withColumn("query_id", F.lit("clash"))
    assert ann.nearest_neighbours(vectors, vectors.limit(1), k=1).dtypes == [
        ("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")
    ]
