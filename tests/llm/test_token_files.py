import numpy as np
import pytest

from corpora import documents, no_documents, rows, texts
from lumenset.llm import token_files


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1000, 4097])
def test_permutation(size):
    out = token_files.permuted(np.arange(size), size, 9)
    assert sorted(out) == list(range(size))
    if size > 100:
        assert (out != token_files.permuted(np.arange(size), size, 10)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(size), out)[0, 1]) < 0.15


def test_records(spark, tmp_path):
    docs, path = documents(spark), f"{tmp_path}/shards"
    found = token_files.token_files(docs, path, length=32, shard_bytes=4000).collect()
    want = token_files.sequences_by_brute_force(texts(), 32)
    assert {(r.doc_id, r.piece): (r.n_ids, r.ids_crc32) for r in found} == want and len(found) == len(want)
    assert sorted(r.slot for r in found) == list(range(len(found)))
    assert len({r.shard for r in found}) > 5
    # the order is that of the keyed permutation
    pieces = -(-(max(len((t or "").encode()) for _, t in texts()) + 1) // 31)
    numbers = np.array([r.doc_id * pieces + r.piece for r in sorted(found, key=lambda r: r.slot)])
    at = token_files.permuted(numbers, (max(i for i, _ in texts()) + 2) * pieces, token_files.KEY)
    assert (np.diff(at) > 0).all()


def test_reading_goes_on_anywhere(spark, tmp_path):
    path = f"{tmp_path}/shards"
    token_files.write_token_shards(documents(spark), path, length=32, shard_bytes=4000)
    whole = {r.slot: (r.doc, r.piece, r.ids, r.byte_offset) for r in token_files.read_sequences(spark, path, 32).collect()}
    shards = token_files.manifest(spark, path, 32)
    assert sum(n for _, _, n in shards) == len(whole)
    first = shards[2][1] - 1
    part = {r.slot: (r.doc, r.piece, r.ids, r.byte_offset) for r in token_files.read_sequences(spark, path, 32, first, 20).collect()}
    assert part == {s: whole[s] for s in range(first, first + 20)}
    rest = token_files.read_sequences(spark, path, 32, len(whole) - 3).collect()
    assert sorted(r.slot for r in rest) == list(range(len(whole) - 3, len(whole)))


def test_repeated_rows_and_rows_without_an_id(spark):
    found = token_files.token_files(documents(spark, True), length=64).collect()
    want = token_files.sequences_by_brute_force(texts(), 64)
    more = [token_files.sequences_by_brute_force([(r[0], r[1])], 64) for r in rows(True)[len(texts()):]]
    assert len(found) == len(want) + sum(map(len, more))
    assert sorted(r.slot for r in found) == list(range(len(found)))
    assert {(r.piece, r.n_ids, r.ids_crc32) for r in found if r.doc_id is None} == {(k[1], *v) for k, v in more[0].items()}


def test_empty_table_and_far_ids(spark):
    assert token_files.token_files(no_documents(spark)).count() == 0
    far = spark.createDataFrame([(-(1 << 62), "a"), (1 << 62, "b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        token_files.token_files(far)
