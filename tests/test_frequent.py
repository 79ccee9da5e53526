"""Frequent texts from bounded counters against whole counts."""

import contextlib
import io
import random
from collections import Counter

import pytest

from lumenset.operators import frequent, values
from lumenset.operators.frequent import all_values, leading_values
from lumenset.operators.profile import top_values


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(2)
    rows = []
    for i in range(6000):
        skewed = "hot" if i % 3 == 0 else f"s{draw.randrange(5000)}"
        rows.append((f"v{i % 9}", f"w{i % 10}", f"u{i}", skewed, None, "y" * 90 if i % 4 else None, f"t{i % 2}", "L" * 70 if i % 2 else f"x{i}", "" if i % 2 else None))
    return spark.createDataFrame(rows, "nine string, ten string, `u.n` string, skewed string, none string, long string, tie string, led string, blank string").repartition(5)


def exact(table, column):
    return Counter(r[0] for r in table.select(f"`{column}`").collect() if r[0] is not None)


def test_columns_of_few_values_come_whole(table):
    found = {}
    for r in all_values(table, table.columns, 9).collect():
        found.setdefault(r.column, {})[r.key if len(r.key) <= 64 else "long"] = r.n
    assert found == {"nine": dict(exact(table, "nine")), "long": {"long": 4500}, "tie": dict(exact(table, "tie")), "blank": {"": 3000}}


def test_top_values(table):
    got = {}
    for r in top_values(table).orderBy("column", "place").collect():
        got.setdefault(r.column, []).append((r.value, r.n))
    assert got == {
        "nine": sorted(exact(table, "nine").items(), key=lambda x: (-x[1], x[0]))[:5], "long": [("y" * 90, 4500)], "tie": [("t0", 3000), ("t1", 3000)], "blank": [("", 3000)]
    }


def test_modes_that_lead(table):
    """Flat columns and long modes are left to whole counts; the others need none."""
    assert leading_values(table, table.columns) == {"nine": "v0", "ten": "w0", "skewed": "hot", "tie": "t0", "blank": ""}


def test_few_counters_never_name_a_wrong_mode(table, monkeypatch):
    monkeypatch.setattr(frequent, "TRACKED", 60)
    for column, mode in leading_values(table, table.columns).items():
        counts = exact(table, column)
        assert mode == min(v for v, n in counts.items() if n == max(counts.values()))


def test_modes_without_a_shuffle_of_all_values(table, monkeypatch):
    whole = []
    real = values.value_counts
    monkeypatch.setattr(values, "value_counts", lambda df, columns, order=None: whole.append(columns) or real(df, columns, order))
    found = values.find_modes(table, table.columns)
    assert whole == [["u.n", "none", "long", "led"]]
    for column in ("nine", "ten", "skewed", "tie", "long", "led", "blank", "u.n"):
        counts = exact(table, column)
        assert found[column] == min(v for v, n in counts.items() if n == max(counts.values()))
    assert "none" not in found


def test_nothing_but_counters_is_shuffled(table):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        all_values(table, ["u.n", "skewed"], 9).explain()
    assert "hashpartitioning" not in out.getvalue() and "SinglePartition" in out.getvalue()
