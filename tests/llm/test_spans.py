import hashlib
import random

import numpy as np

from corpora import documents, no_documents, rows, texts, words
from lumenset.llm import spans
from lumenset.llm.words import hash_words


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    assert got(spans.drop_repeated_spans(documents(spark))) == sorted(spans.kept_by_brute_force(texts()), key=str)


def test_repeated_rows_and_rows_without_an_id(spark):
    want = spans.kept_by_brute_force([(r[0], r[1]) for r in rows(True)])
    assert got(spans.drop_repeated_spans(documents(spark, True))) == sorted(want, key=str)


def test_branching_passages(spark):
    """Short vocabularies and overlapping cuts of one text make many branches."""
    draw = random.Random(5)
    source = words(20, 400).split(" ")
    docs = []
    for i in range(120):
        a = draw.randrange(350)
        cut = source[a : a + draw.randrange(5, 90)]
        if i % 3 == 0:
            cut[draw.randrange(len(cut))] = f"new{i}"
        docs.append((i, " ".join(words(100 + i, draw.randrange(6), 9).split(" ") + cut + ["the"] * (i % 4 * 20))))
    out = spans.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), window=12, anchor=5)
    assert got(out) == sorted(spans.kept_by_brute_force(docs, 12), key=str)


def test_wide_windows_have_long_paths(spark):
    shared = words(21, 900)
    docs = [(i, f"{words(200 + i, 50 * i)} {shared if i % 2 else ''} {words(300 + i, 120)}") for i in range(8)]
    out = spans.drop_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), window=120)
    assert got(out) == sorted(spans.kept_by_brute_force(docs, 120), key=str)


def test_columns_stay_and_an_empty_table_gives_none(spark):
    docs = documents(spark)
    out = spans.drop_repeated_spans(docs)
    assert out.columns == [*[c for c in docs.columns if c != "n_words"], "n_words", "n_removed"]
    assert spans.drop_repeated_spans(no_documents(spark)).count() == 0


def test_paths_hold_every_edge_once():
    texts_ = [words(i, n, 6).encode() for i, n in enumerate((0, 3, 34, 35, 36, 500, 1))]
    hashes, counts = hash_words(texts_)
    _, _, start, n, text = spans.paths_of(hashes, counts, 35, 16)
    edges = [(int(t), int(s) + i) for t, s, m in zip(text, start, n) for i in range(m)]
    assert sorted(edges) == [(t, i) for t, c in enumerate(counts) for i in range(max(0, c - 34))]


def test_words_are_split_at_six_characters(monkeypatch):
    from lumenset.llm import words as module

    texts_ = [t.encode() for t in (" a\tb\x0bc\x0cd\re\nf ", "\x1c\x85 x", "", "longer words " * 400)]
    whole = module.hash_words(texts_)
    assert whole[1].tolist() == [6, 1, 0, 800]
    monkeypatch.setattr(module, "SEGMENT", 50)
    cut = module.hash_words(texts_)
    assert (cut[0] == whole[0]).all() and (cut[1] == whole[1]).all()
    assert len(np.unique(whole[0])) == 6 + 1 + 2
