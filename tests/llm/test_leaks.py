import random

import pytest

from corpora import documents, no_documents, rows, texts, words
from lumenset.llm import leaks

ITEM = "item_id long, text string, doc_id string, n_words int"


def benchmark(extra=()):
    passage, base = words(1, 60), words(2, 300).split(" ")
    out = [
        passage, " ".join(base[40:60]), " ".join(base[90:111]).upper(), " ".join(base[:10]), "Four words are here", "one", "", None, " ,;\t ", "nowhere at all to be found",
        "and another, again!", words(77, 50), " ".join(base[50:60]) + " tail", "straße äöü", "x" * 5000, passage, "日本語",
    ]
    return list(enumerate([*out, *extra]))


def items(spark, found):
    return spark.createDataFrame([(i, t, "clash", 3) for i, t in found], ITEM)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def want(docs, found, window=10):
    return sorted(leaks.leaks_by_brute_force(docs, found, window), key=str)


def test_matches_brute_force(spark):
    out = leaks.find_leaks(documents(spark), items(spark, benchmark()))
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got(out) == want(texts(), benchmark())


@pytest.mark.parametrize("window,shingle", [(10, 4), (3, 2), (25, 1), (7, 7)])
def test_short_vocabularies(spark, window, shingle):
    """Windows that nearly occur, at both ends of documents, with shingles that many windows and documents share."""
    draw = random.Random(window)
    source = words(30, 300, 12).split(" ")
    cut = lambda longest: " ".join(source[(a := draw.randrange(280)) : a + draw.randrange(longest)])
    docs = [(i, f"{words(40 + i, draw.randrange(4), 12)} {cut(60)}") for i in range(150)] + [(1000 + i, "w1 w2 w3 w1 w2 w3 w4") for i in range(40)]
    found = [(i, cut(40)) for i in range(25)] + [(50, "w1 w2"), (50, "w3"), (None, "w2 w3 w1"), (None, cut(30))]
    out = leaks.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(found, "item_id long, text string"),
        window=window, shingle=shingle,
    )
    assert got(out) == want(docs, found, window)


def test_repeated_rows_rows_without_an_id_and_nothing_at_all(spark):
    found = [*benchmark(), *benchmark()[:3], (None, words(2, 12))]
    assert got(leaks.find_leaks(documents(spark, True), items(spark, found))) == want([(r[0], r[1]) for r in rows(True)], found)
    assert got(leaks.find_leaks(documents(spark), items(spark, []))) == want(texts(), [])
    assert leaks.find_leaks(no_documents(spark), items(spark, benchmark())).count() == 0


def test_the_sieve_may_let_everything_through(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_BITS", 64)
    assert got(leaks.find_leaks(documents(spark), items(spark, benchmark()))) == want(texts(), benchmark())


def test_words_around_are_read_by_segments(monkeypatch):
    import numpy as np

    from lumenset.llm import words as module

    text = words(3, 500).encode()
    lo, hi = np.array([0, 3, 120, 490]), np.array([7, 20, 130, 500])
    monkeypatch.setattr(module, "SEGMENT", 30)
    assert [w.decode() for w in leaks.words_around(text, lo, hi)] == [" ".join(text.decode().split()[a:b]) for a, b in zip(lo, hi)]
