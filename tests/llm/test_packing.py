import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpora import documents, no_documents, rows, texts, words
from lumenset.llm import packing, tokens


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_of(exact, text):
    return exact.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_equal_those_of_the_tokenizers_library(exact):
    odd = ["a" * 4000, " " * 4000 + "x", "Ᲊࡰ new letters", "مرحبا بالعالم", "'s 'LL don't  \n\n x", "​﻿", "<|endoftext|>x", "12345 ½ ⅷ"]
    for text in [t for _, t in texts()] + odd:
        got = tokens.token_ids(None if text is None else text.encode(), tokens.default_path())
        assert got.tolist() == ids_of(exact, text)[:-1]


def check(pieces, docs, exact, capacity):
    want = Counter()
    for doc, text in docs:
        ids = np.array(ids_of(exact, text), dtype="<u4")
        first = len(ids) % capacity or capacity
        for number, (begin, end) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
            want[doc, number, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_places(spark, exact, capacity):
    pieces = packing.pack_documents(documents(spark, True), capacity=capacity).collect()
    many = check(pieces, [(r[0], r[1]) for r in rows(True)], exact, capacity)
    assert many <= -(-sum(p.length for p in pieces) // capacity) * 1.1 + 1


def test_one_length_over_many_buckets(spark, exact, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 10)
    docs = [(i, words(i % 7, 30)) for i in range(200)] + [(i, "") for i in range(200, 300)]
    pieces = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), capacity=100).collect()
    check(pieces, docs, exact, 100)


def test_sequences_hold_the_ids(spark, exact):
    docs = documents(spark)
    packed = packing.pack_documents(docs, capacity=64)
    sequences = {r.sequence_id: r.ids for r in packing.sequence_ids(docs, packed).collect()}
    ids = {doc: ids_of(exact, text) for doc, text in texts()}
    for p in packed.collect():
        assert sequences[p.sequence_id][p.offset : p.offset + p.length] == ids[p.doc_id][p.start : p.start + p.length]


def test_an_empty_table_gives_none(spark):
    assert packing.pack_documents(no_documents(spark)).count() == 0


def test_plan_is_best_fit_decreasing():
    draw = random.Random(4)
    for capacity in (7, 50, 300):
        sizes = [min(capacity, 1 + int(draw.expovariate(4 / capacity))) for _ in range(400)]
        runs = packing.best_fit(Counter(sizes), capacity)
        assert {r[0]: sum(x[2] for x in runs if x[0] == r[0]) for r in runs} == Counter(sizes)
        room = []
        for size in sorted(sizes, reverse=True):
            fits = [i for i, r in enumerate(room) if r >= size]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= size
            else:
                room.append(capacity - size)
        assert 1 + max(r[4] + (r[2] - 1) // r[3] for r in runs) == len(room)
    assert packing.best_fit({}, 10) == []
