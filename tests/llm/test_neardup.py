import random

import numpy as np

from corpora import documents, no_documents, rows, texts, words
from lumenset.llm import neardup


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def variants(seed: int, n: int, changes: int) -> list[str]:
    """Copies of one text, each with some words replaced."""
    draw = random.Random(seed)
    base = words(seed, 200).split(" ")
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(draw.randrange(changes + 1)):
            copy[draw.randrange(len(copy))] = f"v{i}"
        out.append(" ".join(copy))
    return out


def test_matches_brute_force(spark):
    found = neardup.near_duplicate_groups(documents(spark))
    assert got(found) == neardup.groups_by_brute_force(texts())
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_groups_of_near_copies(spark):
    """Chains of links, and links around the threshold."""
    docs = [t for s in range(8) for t in variants(s, 25, 12)] + [words(i, 150) for i in range(900, 960)]
    random.Random(1).shuffle(docs)
    docs = list(enumerate(docs, 100))
    found = neardup.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert got(found) == neardup.groups_by_brute_force(docs)


def test_buckets_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    docs = list(enumerate([t for s in range(3) for t in variants(s, 30, 14)]))
    found = neardup.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert got(found) == neardup.groups_by_brute_force(docs)


def test_repeated_rows_and_rows_without_an_id(spark):
    found = neardup.near_duplicate_groups(documents(spark, True)).collect()
    assert len(found) == len(rows(True))
    assert [(r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is None] == [(296, None, True)]
    by_id = {r.doc_id: r.component_id for r in found}
    assert {k: v for k, v in by_id.items() if k is not None} == {i: c for i, _, c in neardup.groups_by_brute_force(texts())}


def test_rows_of_one_id_are_linked(spark):
    docs = [(1, words(1, 50)), (1, words(2, 50)), (2, words(2, 50)), (3, words(1, 50)), (4, words(3, 50))]
    found = neardup.near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_one_of_each_stays_with_its_columns(spark):
    docs = documents(spark, True)
    kept = neardup.keep_one_of_each(docs)
    assert kept.schema == docs.schema
    want = [i for i, _, c in neardup.groups_by_brute_force(texts()) if i == c]
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == want
    assert kept.filter("doc_id is null").count() == 1
    assert neardup.near_duplicate_groups(no_documents(spark)).count() == 0
    assert neardup.keep_one_of_each(no_documents(spark)).count() == 0


def test_components(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)]
    found = {r.id: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {i: i for pair in links for i in pair}
    for _ in range(70):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {i: c for i, c in root.items() if i != c}


def test_the_test_keeps_what_is_similar():
    needed = neardup.least_matches(0.75, 1e-6)
    draw = np.random.default_rng(0)
    left = draw.integers(0, 1 << 16, (20000, neardup.HASHES)).astype(np.uint16)
    right = np.where(draw.random(left.shape) < 0.75, left, left + np.uint16(1))
    every = np.arange(len(left))
    assert len(neardup.survivors(left, right, every, every, needed)) >= 0.999 * len(left)
    other = np.where(draw.random(left.shape) < 0.3, left, left + np.uint16(1))
    assert len(neardup.survivors(left, other, every, every, needed)) < 0.01 * len(left)
