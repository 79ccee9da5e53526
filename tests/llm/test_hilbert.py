import itertools
import zlib
from collections import Counter

import numpy as np
import pytest

from corpora import documents, no_documents, rows
from lumenset.llm import hilbert


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.curve_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    placed = hilbert.hilbert_shards(documents(spark, True)).collect()
    counts = Counter(r.shard for r in placed)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(8))
    for shard, many in counts.items():
        assert sorted(r.slot for r in placed if r.shard == shard) == list(range(many))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows(True))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in placed) == want
    order = [r.curve for r in sorted(placed, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_every_row_count(spark):
    for n in (1, 5, 8, 9, 23):
        df = spark.createDataFrame([(i, "x" * i, None, "s") for i in range(n)], "doc_id long, text string, lang string, source string")
        counts = Counter(r.shard for r in hilbert.hilbert_shards(df).collect())
        assert sorted(counts.values(), reverse=True) == sorted(([n // 8 + (i < n % 8) for i in range(min(n, 8))]), reverse=True)
    assert hilbert.hilbert_shards(no_documents(spark)).count() == 0


def test_files_prune_by_any_dimension(spark, tmp_path):
    docs = [(i, "word " * (i * 7 % 300 + 1), f"l{i % 4}", f"s{i // 4 % 4}") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    path = f"{tmp_path}/out"
    placed = {r.doc_id: (r.shard, r.slot) for r in hilbert.write_shards(df, path, shards=16).collect()}
    written = spark.read.parquet(path)
    assert {r.doc_id: (r._shard, r._slot) for r in written.collect()} == placed
    # a plain cut by id leaves every value in every shard
    for column in ("lang", "source"):
        spread = [r[1] for r in written.selectExpr(column, "_shard").distinct().groupBy(column).count().collect()]
        assert max(spread) <= 12 and sum(spread) / len(spread) <= 8
