import hashlib
import random
import zlib

import numpy as np
import pytest

from corpora import documents, no_documents, rows, texts, words
from lumenset.llm import periods, queries
from pyspark.sql import functions as F


def collapsed_by_brute_force(split, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(split) if i not in gone)


def expected(text):
    split = [w.decode() for w in (text or "").encode().split()]
    runs = periods.runs_by_brute_force(split)
    return len(split), runs, collapsed_by_brute_force(split, runs)


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.text))
    return out


def sequences():
    draw = random.Random(3)
    for _ in range(400):
        symbols = draw.choice((1, 2, 3, 6))
        out = [draw.randrange(symbols) for _ in range(draw.randrange(60))]
        period = out[: draw.randrange(1, 14)]
        yield out + period * draw.randrange(9) + period[: draw.randrange(5)] + out[draw.randrange(5) :]


def test_matches_brute_force_however_it_is_appended():
    draw = random.Random(4)
    for sequence in sequences():
        catchers, at = periods.Catchers(), 0
        while at < len(sequence):
            step = draw.choice((1, 2, 5, 200))
            catchers.append(np.array(sequence[at : at + step], dtype=np.int64))
            at += step
        assert [tuple(r) for r in catchers.runs().tolist()] == periods.runs_by_brute_force(sequence), sequence


def test_more_periods_may_be_asked_for_but_not_fewer():
    for sequence in sequences():
        catchers = periods.Catchers(exponent=6, least=20)
        catchers.append(np.array(sequence, dtype=np.int64))
        assert [tuple(r) for r in catchers.runs().tolist()] == periods.runs_by_brute_force(sequence, 6, 20)
    with pytest.raises(ValueError):
        periods.Catchers(exponent=3)


def test_doubling_words_and_long_periods():
    """Words of a text without cubes have no run; a period of half a thousand words has one."""
    doubled = [bin(i).count("1") % 2 for i in range(5000)]
    period = [i % 499 for i in range(500)]
    for sequence in (doubled, doubled[:300] + period * 5 + doubled[:77]):
        catchers = periods.Catchers()
        catchers.append(np.array(sequence))
        found = [tuple(r) for r in catchers.runs().tolist()]
        assert found == periods.runs_by_brute_force(sequence)
    assert len(found) == 1


def test_fingerprints_do_not_decide(monkeypatch):
    """With fingerprints that are all equal the words alone tell the runs."""
    monkeypatch.setattr(periods, "_RIGHT", np.uint64(0))
    monkeypatch.setattr(periods, "_LEFT", np.uint64(0))
    for sequence in list(sequences())[:100]:
        catchers = periods.Catchers()
        catchers.append(np.array(sequence, dtype=np.int64))
        assert set(periods.runs_by_brute_force(sequence)) == {tuple(r) for r in catchers.runs().tolist()}


def test_documents(spark):
    out = periods.collapse_runs(documents(spark))
    assert out.columns == [*[c for c in documents(spark).columns if c != "n_words"], "n_words", "runs", "strongest"]
    found = got(out)
    for i, text in texts():
        if len(text or "") < 20_000:
            assert found[i] == [expected(text)]
    assert sum(len(f[0][1]) for f in found.values()) >= 3


def test_repeated_rows_rows_without_an_id_and_no_rows(spark):
    found = got(periods.collapse_runs(documents(spark, True)))
    assert sum(map(len, found.values())) == len(rows(True))
    assert found[None] == [expected(words(2, 300))]
    assert periods.collapse_runs(no_documents(spark)).count() == 0


def test_strongest_run():
    runs = np.array([(0, 8, 2), (20, 9, 2), (40, 18, 4), (60, 13, 3), (80, 9, 2)])
    assert periods.strongest(runs) == {"start": 20, "length": 9, "period": 2}
    assert periods.strongest(runs[:0]) is None


def test_long_texts_are_cut_into_segments(monkeypatch):
    from lumenset.llm import words as module

    text = " ".join(["x y z"] * 50 + ["again"] * 30 + [words(5, 300, 4)]).encode()
    whole = periods.runs_of([b"", text, text])
    monkeypatch.setattr(module, "SEGMENT", 40)
    monkeypatch.setattr(periods, "APPENDED", 16)
    cut = periods.runs_of([b"", text, text])
    assert all((a == b).all() for a, b in zip(whole, cut))
    assert periods.collapsed(text, cut[0][cut[1] == 1], 480).decode() == expected(text.decode())[2]


def test_query(spark, sf_dir):
    """The query against the contract in plain Python, over documents small enough for brute force."""
    docs = [(i, t) for i, t in texts() if len(t or "") < 20_000] + [(i + 1000, words(i, 90, 40)) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    planted = {r.doc_id: r.text for r in queries.planted_periods(frame).collect()}
    changed = 0
    for i, text in docs:
        h, split = zlib.crc32(str(i).encode()), (text or "").encode().split()
        g, n = h // 10, len(split)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            split = [split[j] if j < a else split[a + (j - a) % p] for j in range(n)]
            changed += 1
        assert (planted[i] or "").encode().split() == split
    assert changed >= 3


def test_query_digests(spark, sf_dir):
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.length("text") < 1500).select("doc_id", "text").limit(120)
    texts_ = {r.doc_id: r.text for r in queries.planted_periods(kept).collect()}
    result = {r.doc_id: r for r in queries.op11_periods(spark, sf_dir).collect()}
    for i, text in texts_.items():
        n, runs, left = expected(text)
        r = result[i]
        assert (r.n_runs, r.collapsed_sha256) == (len(runs), hashlib.sha256(left.encode()).hexdigest())
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None,) * 3
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
