import hashlib
import random

import numpy as np

from corpora import documents, no_documents, rows, texts
from lumenset.llm import lines


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, digest(r.text)) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    assert got(lines.drop_repeated_lines(documents(spark))) == sorted(lines.kept_by_brute_force(texts()), key=str)


def test_repeated_rows_and_rows_without_an_id(spark):
    want = lines.kept_by_brute_force([(r[0], r[1]) for r in rows(True)])
    assert got(lines.drop_repeated_lines(documents(spark, True))) == sorted(want, key=str)


def test_columns_stay_and_an_empty_table_gives_none(spark):
    docs = documents(spark)
    out = lines.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {(r["_id"], r["dotted.name"], r["n_words"]) for r in out.collect()} == {(7, "d", "clash")}
    assert lines.drop_repeated_lines(no_documents(spark)).count() == 0


def test_random_documents_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 7)
    monkeypatch.setattr(lines, "PROBES_PER_CELL", 20)
    draw = random.Random(3)
    pool = [f"this is line number {i}" for i in range(60)]
    # one line is in almost every document
    docs = [(i, "\n".join(["the line of a third"] * (i % 3 > 0) + draw.choices(pool, k=draw.randrange(8)))) for i in range(300)]
    out = lines.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert got(out) == sorted(lines.kept_by_brute_force(docs), key=str)


def test_perfect_hash_places_every_key_once():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    levels, place = lines.build_index(keys)
    assert sorted(place) == list(range(5000))
    assert (lines.look_up(levels, keys) == place).all()
    assert lines.look_up(levels, np.array([], dtype=np.uint64)).size == 0


def test_keys():
    assert lines.line_key(b" \t Ab CD efgh \r", 10) == b"ab cd efgh"
    assert lines.line_key("äöüäöüäöü".encode(), 10) is None
    assert lines.line_key("äöüäöüäöüä".encode(), 10) is not None
