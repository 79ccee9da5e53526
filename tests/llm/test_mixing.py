import random

import pytest
from pyspark.sql import functions as F

from corpora import documents, no_documents, rows
from lumenset.llm import mixing


def targets(sizes: dict, cap: int = 3) -> dict:
    """Shares of all sizes by weight 1, 2, 3, ..., none above cap times its source, found by plain repetition."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in sizes if s not in full)
        share = {s: cap * sizes[s] if s in full else left * weight[s] / open_weight for s in sizes}
        more = {s for s in sizes if s not in full and share[s] > cap * sizes[s]}
        if not more:
            return share
        full |= more


def check(df, tolerance):
    out = df.collect()
    sizes, taken, target = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert all(r.source_size == sizes[s] for r in out if r.source == s)
        assert abs(taken[s] - want[s]) <= tolerance(sizes[s], max([r.size for r in out if r.source == s]))
    return out


def test_sources_meet_their_targets(spark):
    draw = random.Random(1)
    docs = []
    # one source holds most words, one very few, one none
    for source, n in (("big", 1500), ("B", 300), ("ä", 250), ("tiny", 4), ("b", 200), (None, 150), ("blank", 5), ("日", 40)):
        for _ in range(n):
            size = 0 if source == "blank" else int(draw.lognormvariate(4, 1)) + 1
            docs.append((len(docs), "w " * size, source))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    out = check(mixing.document_copies(df), lambda size, largest: max(0.005 * size, 0.6 * largest if size < 2000 else 40))
    again = mixing.document_copies(df.repartition(2)).collect()
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in again)


def test_rates_tilt_with_the_words(spark):
    docs = [(i, "w " * (1 + i % 50), "a" if i < 100 else "b") for i in range(200)]
    out = mixing.document_copies(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    short = [r.copies for r in out if r.source == "a" and r.size <= 5]
    long = [r.copies for r in out if r.source == "a" and r.size > 45]
    assert sum(short) / len(short) > sum(long) / len(long)


def test_odd_rows(spark):
    docs = documents(spark, True)
    out = mixing.document_copies(docs)
    assert out.columns == [*[c for c in docs.columns if c != "size"], "size", "source_size", "target", "copies"]
    found = check(out, lambda size, largest: 0.6 * largest + 1)
    assert len(found) == len(rows(True))
    assert {r.copies for r in found if r.size == 0} == {1}
    mixed = mixing.mix_documents(docs)
    assert mixed.schema == docs.schema
    assert mixed.count() == sum(r.copies for r in found)
    assert mixing.document_copies(no_documents(spark)).count() == 0


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.copies) for r in mixing.document_copies(docs).collect()} == {(1, 0, 0.0, 1), (2, 0, 0.0, 1)}


def test_words(spark):
    texts = [None, "", " \t\x0b", "a", " a b\nc d "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.n_words(F.col("text"))).collect()] == [0, 0, 0, 1, 3]
