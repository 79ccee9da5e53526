import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpora import documents, no_documents, texts, words
from lumenset.llm import rules


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, in plain Python."""
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = [False] * len(found)
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            covered[i : i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(covered)


NONE = rules.DecisionList(())


def test_counts(spark):
    found = {r.doc_id: r for r in rules.judge(documents(spark), NONE).collect()}
    for doc, text in texts():
        r = found[doc]
        assert (int(r.n_words), r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text)
        assert r.base_failed == (counts(text)[0] < 50 or 100 * counts(text)[4] > 50 * counts(text)[0])
        assert r.kept == (not r.base_failed)


@pytest.mark.parametrize("vocabulary", [2, 3, 8])
def test_repeated_windows(spark, vocabulary):
    cases = [words(i, i % 23, vocabulary) for i in range(150) if i % 23]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in rules.judge(rows, NONE).collect()} == {i: counts(t)[4] for i, t in enumerate(cases)}


def labelled(spark):
    """Half of the bad texts are full of symbols, half in capitals; a few labels are wrong."""
    draw = random.Random(7)
    docs, labels = [], []
    for i in range(1500):
        text, bad = words(i, 60 + i % 50, 3000), i % 4 == 0
        if bad:
            text = text.replace(" ", " ## ") if i % 8 else text.upper()
        docs.append((i, text))
        labels.append((i, int(not bad) if draw.random() > 0.003 else int(bad)))
    labels += [(None, 1), (3, None), (99_999, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_hold_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    held_out = F.col("doc_id") % 3 == 1
    learned = rules.fit_rules(docs.filter(~held_out), labels)
    assert len(learned.rules) >= 2
    judged = rules.judge(docs.filter(held_out), learned).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in judged)
    assert all((r.rule > 0) == (not r.kept) for r in judged)
    assert rules.keep_good(docs.filter(held_out), learned).count() == sum(r.kept for r in judged)


def test_a_region_of_wrong_labels_does_not_end_the_list(spark):
    draw = random.Random(3)
    rows = []
    for i in range(3000):
        ratios = {n: draw.random() for n in rules.RATIOS}
        noisy, clean = i % 5 == 0, i % 10 == 1
        ratios["symbols_per_word"] += 2 * noisy
        ratios["capitals_per_char"] += 2 * clean
        rows.append(((noisy and draw.random() > 0.1) or clean, int(draw.random() < 1 / 3), *ratios.values()))
    names = ["bad", "half", *rules.RATIOS]
    learned = rules.learn(spark.createDataFrame(rows, names))
    rejected = [r for r in rows if any(all((dict(zip(names, r))[c.statistic] > c.threshold) == c.above for c in rule) for rule in learned.rules)]
    clean = [r for r in rows if dict(zip(names, r))["capitals_per_char"] > 2]
    assert sum(r in rejected for r in clean) > 0.95 * len(clean)
    assert sum(r[0] for r in rejected) >= 0.98 * len(rejected)


def test_a_bounded_sample_gives_the_same_every_time(spark):
    docs, labels = labelled(spark)
    first = rules.fit_rules(docs, labels, sample=400)
    assert str(first) == str(rules.fit_rules(docs.repartition(7), labels.repartition(3), sample=400)) and first.rules


def test_nothing_to_learn(spark):
    docs, labels = labelled(spark)
    assert rules.fit_rules(docs, labels.filter("quality = 1")) == NONE
    assert rules.fit_rules(docs, labels.filter("quality = 5")) == NONE
    assert rules.fit_rules(docs.filter("doc_id < 0"), labels) == NONE
    assert str(NONE) == "keep all"


def test_columns_stay(spark):
    docs = documents(spark, True)
    judged = rules.judge(docs, NONE)
    assert [c for c in judged.columns if c in docs.columns] == [c for c in docs.columns if c not in ("n_words", "kept")] + ["n_words", "kept"]
    assert judged.count() == docs.count()
    assert rules.keep_good(docs, NONE).schema == docs.schema
    assert rules.judge(no_documents(spark), NONE).count() == 0


def test_no_python_and_no_shuffle(spark):
    judged = rules.judge(documents(spark, parts=1), rules.DecisionList(((rules.Condition("word_length", True, 9.0),),)))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    # the counts are computed once, in the generator
    assert plan.count("array_distinct") == 1
