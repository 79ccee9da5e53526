"""The stages over the given documents, each against brute force on the rows it was given."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumenset.llm import lines, neardup, packing, rules, tokens
from lumenset.llm.frames import stored
from test_mixing import targets
from test_rules import counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), "step"))
    return [df.collect() for df in out], [df.columns for df in out]


def test_columns(steps):
    rows, columns = steps
    assert all(c == COLUMNS for c in columns[:-1])
    assert all(len(r) > 0 for r in rows)


def test_rules_reject_what_is_labelled_bad(steps, spark, sf_dir):
    before, after = steps[0][:2]
    kept = {r.doc_id for r in after}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for r in before:
        n = counts(r.text)
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            assert r.doc_id not in kept
        elif r.doc_id in quality:
            assert (r.doc_id in kept) == (quality[r.doc_id] == 1)


def test_lines(steps):
    """Lines go as by brute force; documents that this leaves with fewer than 50 words go as a whole."""
    before, after = steps[0][1:3]
    cut = lines.kept_by_brute_force([(r.doc_id, r.text) for r in before])
    left = {r.doc_id: r for r in after}
    for doc, _, dropped, digest in cut:
        if doc in left:
            assert hashlib.sha256(left[doc].text.encode()).hexdigest() == digest
            assert not dropped or len(left[doc].text.encode().split()) >= 50
    assert {d for d, _, dropped, _ in cut if not dropped} <= set(left)
    gone = [d for d, _, dropped, _ in cut if d not in left]
    texts = {r.doc_id: r.text for r in before}
    kept_lines = {d: h for d, _, _, h in cut}
    # each that is gone was cut: its kept text is short
    again = lines.kept_by_brute_force([(r.doc_id, r.text) for r in before])
    assert gone and all(dropped for d, _, dropped, _ in again if d in gone) and set(gone) <= set(texts) and len(kept_lines) == len(before)
    assert all(r.n_chars == len(r.text) for r in after)


def test_nothing_empty_or_cut_to_a_remnant_is_packed(steps):
    assert all(len(r.text.encode().split()) >= 50 for r in steps[0][4])


def test_near_duplicates(steps):
    before, after = steps[0][2:4]
    want = [d for d, _, c in neardup.groups_by_brute_force([(r.doc_id, r.text) for r in before]) if d == c]
    assert sorted(r.doc_id for r in after) == want


def test_mix(steps):
    before, after = steps[0][3:5]
    assert set(Counter(after)) <= set(before) and max(Counter(after).values()) <= 3
    size = lambda r: len(r.text.encode().split())
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += size(r)
    for r in after:
        taken[r.source] += size(r)
    for source, want in targets(sizes).items():
        assert abs(taken[source] - want) <= 0.05 * want


def test_packing(steps):
    before, after = steps[0][4:6]
    ids = [(r.doc_id, np.append(tokens.token_ids(r.text.encode(), tokens.default_path()), 0).astype("<u4")) for r in before]
    want = Counter((d, s, n, zlib.crc32(x[s : s + n].tobytes())) for d, x in ids for s, n in packing.cut(len(x), 2048))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in after) == want
    filled = Counter()
    for r in after:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) * 1.02 + 1


def test_run_equals_the_stages(steps, spark, sf_dir):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(key, steps[0][-1]))


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "empty")
    assert docs.count() == 0


def test_learned_rules_are_conditions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rules.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).rules
