"""Average ranks and their correlations against pandas."""

import contextlib
import io
import random
import re

import pandas as pd
import pytest

from lumenset.operators import ranks
from lumenset.operators.ranks import rank_correlations, ranked_columns


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(7)
    rows = [(i, float(draw.randrange(6)), None if i % 4 == 0 else draw.gauss(0, 1), 1.0, None, 0.0 if i % 3 else float(i)) for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, ties double, `g.aps` double, fixed double, none double, hot double").repartition(7)


def test_ranks_are_those_of_pandas(table):
    names = ["ties", "g.aps", "hot"]
    want = pd.DataFrame([tuple(r) for r in table.collect()], columns=table.columns)[names].astype(float).rank()
    got = ranked_columns(table, names).toPandas()
    assert got.columns.tolist() == names
    pd.testing.assert_frame_equal(got.sort_values(names, ignore_index=True), want.sort_values(names, ignore_index=True), check_dtype=False)


def test_ranks_of_frequent_values_are_broadcast(table, capfd):
    names = ["ties", "g.aps", "hot"]
    want = pd.DataFrame([tuple(r) for r in table.collect()], columns=table.columns)[names].astype(float).rank()
    found = ranked_columns(table, names, hot_rows=400)
    found.explain()
    assert "BroadcastHashJoin" in capfd.readouterr().out
    pd.testing.assert_frame_equal(found.toPandas().sort_values(names, ignore_index=True), want.sort_values(names, ignore_index=True), check_dtype=False)


def test_correlations_of_ranks(table):
    names = ["ties", "g.aps", "fixed", "none", "hot"]
    frame = pd.DataFrame([tuple(r) for r in table.collect()], columns=table.columns)[names].astype(float).rank()
    for r in rank_correlations(table, names).collect():
        want = frame[r.x].corr(frame[r.y]) if {r.x, r.y}.isdisjoint({"fixed", "none"}) else None
        assert (r.r is None) == (want is None) and (want is None or r.r == pytest.approx(want, abs=1e-9)), r
        assert r.n == (frame[r.x].notna() & frame[r.y].notna()).sum()


def test_one_column_and_no_rows(spark, table):
    assert rank_correlations(table, ["ties"]).count() == 0
    assert [(r.r, r.n) for r in rank_correlations(table.limit(0), ["ties", "hot"]).collect()] == [(None, 0)]


def test_no_window_over_a_whole_column(table, monkeypatch):
    plans = []
    real = ranks.cut_lineage

    def seen(df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
        plans.append(out.getvalue())
        return real(df)

    monkeypatch.setattr(ranks, "cut_lineage", seen)
    ranked_columns(table, ["ties", "hot"]).count()
    assert any("rangepartitioning" in p for p in plans)
    assert not any(re.search("SinglePartition", p) for p in plans)
