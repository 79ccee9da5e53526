"""The registered queries: columns and types of their results, and their SQL."""

import pytest

import __spark_entry__ as entry
from lumenset.llm import queries
from oracle import compare

LONG, TEXT = "bigint", "string"
RESULTS = {
    "op1_ann": {"query_id": LONG, "rank": "int", "vec_id": LONG, "score": "double"},
    "op2_spans": {"doc_id": LONG, "n_words": LONG, "n_removed": LONG, "kept_sha256": TEXT},
    "op3_packing": {"doc_id": LONG, "piece": "int", "start": LONG, "length": LONG, "ids_crc32": LONG, "sequence_id": LONG, "offset": LONG},
    "op4_token_files": {"doc_id": LONG, "piece": "int", "slot": LONG, "shard": "int", "byte_offset": LONG, "n_ids": LONG, "ids_crc32": LONG},
    "op5_neardup": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG, "kept": "boolean"},
    "op6_hilbert": {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": TEXT, "shard": "int", "slot": LONG, "grown_shard": "int"},
    "op7_lines": {"doc_id": LONG, "n_lines": LONG, "n_dropped": LONG, "kept_sha256": TEXT},
    "op8_mixing": {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": "double", "taken": LONG},
    "op9_article": {"page_id": LONG, "url": TEXT, "text": TEXT, "n_chars": LONG},
    "op10_rules": {
        "doc_id": LONG, "n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG,
        "base_failed": "boolean", "kept": "boolean",
    },
    "op11_periods": {
        "doc_id": LONG, "n_runs": LONG, "start": LONG, "length": LONG, "period": LONG, "exponent_milli": LONG, "runs_sha256": TEXT, "collapsed_sha256": TEXT,
    },
    "op12_middles": {
        "doc_id": LONG, "n": LONG, "form": TEXT, "prefix_chars": LONG, "middle_chars": LONG, "output_sha256": TEXT, "restored_sha256": TEXT,
    },
    "op13_leaks": {"doc_id": LONG, "n_words": LONG, "n_hit": LONG, "n_items": LONG, "items_sha256": TEXT, "contaminated": "boolean"},
}


def test_all_are_registered():
    assert set(queries.QUERIES) == {*RESULTS, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(RESULTS))
def test_columns(spark, name):
    found = dict(queries.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
    assert RESULTS[name].items() <= found.items()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    rows, _, message = compare(spark, sf_dir, name)
    assert not message, message
    assert rows > 0
