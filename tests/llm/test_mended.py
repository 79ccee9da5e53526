"""Cases that gave wrong results once."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenset.llm import ann, article, hilbert, neardup, packing, spans
from lumenset.llm.words import hash_words


def doubling(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_in_a_polynomial(spark, n):
    first, second = doubling(n, "a", "b"), doubling(n, "b", "a")
    assert len(set(hash_words([f"{first} {second}".encode()])[0].tolist())) == 2
    docs = [(1, " ".join([first] * 3 + ["x"] + [first, second] * 20)), (2, " ".join([second] * 3 + ["y"] + [second, first, first] * 14))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in spans.drop_repeated_spans(frame).collect()]
    assert sorted(out) == sorted(spans.kept_by_brute_force(docs))
    small = [(1, f"{first} one two three four"), (2, f"{second} one two three four")]
    groups = neardup.near_duplicate_groups(spark.createDataFrame(small, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in groups) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("length", [1e6, 1e160])
def test_vectors_far_longer_than_others(spark, length):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1500, 24))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[[7, 40, 300]] *= length
    ids = np.arange(1500)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    asked = ids[ids % 20 == 0]
    got = {}
    for r in ann.nearest_neighbours(frame, frame.filter("vec_id % 20 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = ann.nearest_by_brute_force(ids, vectors, asked, 10)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    shared = [len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(shared) >= 0.9 * 10 * len(want)
    # the outsize vectors are scored exactly
    for q in want:
        big = {i: s for i, s in want[q] if i in (7, 40, 300)}
        assert {i: s for _, i, s in got[q] if i in big} == pytest.approx(big)


def text_of(page):
    return article.article_text(page.encode())


STORY = "<p>" + "</p><p>".join("The river rose in the night and the mill stood still, said the miller to all who asked him." for _ in range(8)) + "</p>"
TALK = "<p>I liked this a lot, and so did my whole family, thank you very much!</p>"


@pytest.mark.parametrize("name", ["reader-comments", "user-comments", "comment-body", "ad-slot", "ad-unit", "adSlot"])
@pytest.mark.parametrize("place", ["beside", "inside", "no article"])
def test_names_of_comments_and_adverts_in_any_part(name, place):
    block = f'<div class="{name}">{TALK}{TALK}</div>'
    body = {"beside": f"<article>{STORY}</article>{block}", "inside": f"<article>{STORY}{block}</article>", "no article": f"<div>{STORY}</div>{block}"}[place]
    assert "my whole family" not in text_of(f"<html><body>{body}</body></html>")
    assert text_of(f"<html><body>{body}</body></html>").count("the miller") == 8


def test_such_names_around_the_article_or_most_of_the_text_cut_nothing():
    for page in (f'<div class="has-comments"><article>{STORY}</article></div>', f'<div class="ad-free">{STORY}</div>'):
        assert text_of(f"<html><body>{page}</body></html>").count("the miller") == 8


def test_deep_pages_take_linear_time():
    page = "<html><body>" + "<div>" * 50_000 + "</b>" * 50_000 + STORY + "</body></html>"
    start = time.time()
    text = text_of(page)
    assert time.time() - start < 6 and text.count("the miller") == 8


def test_ids_of_several_texts_are_refused(spark):
    docs = spark.createDataFrame([(1, "one text"), (1, "another"), (None, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="several texts"):
        packing.sequence_ids(docs, packing.pack_documents(docs))
    same = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "x"), (2, None)], "doc_id long, text string")
    found = packing.sequence_ids(same, packing.pack_documents(same)).collect()
    placed = packing.pack_documents(same).agg(F.sum("length")).first()[0]
    assert sum(len(r.ids) for r in found) == placed


def test_shards_of_rows_with_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", i, "x", i) for i in range(40)], "doc_id long, text string, lang string, source string, _shard int, shard string, slot int")
    hilbert.write_shards(docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert back.groupBy("__shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    with pytest.raises(ValueError, match="distinct"):
        hilbert.write_shards(docs.unionByName(docs.limit(1)), f"{tmp_path}/again")


def test_line_stage_keeps_clashing_columns_and_drops_remnants(spark, sf_dir):
    draw = random.Random(3)
    line = lambda n: " ".join(f"w{draw.randrange(500)}" for _ in range(n))
    shared = "\n".join(line(12) for _ in range(6))
    docs = [
        (1, f"{shared}\n{line(60)}", 7, "a"), (2, f"{shared}\n{line(60)}", 8, "b"), (3, f"{shared}\n{line(20)}", 9, "c"), (4, shared, 1, "d"), (5, line(10), 2, "e"),
        (6, None, 3, "f"), (7, "", 4, "g"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_lines int, n_dropped string")
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, frame, sf_dir).collect()}
    assert set(out) == {1, 2, 5, 6, 7}
    assert [(out[i].n_lines, out[i].n_dropped) for i in (1, 2, 5)] == [(7, "a"), (8, "b"), (2, "e")]
    assert out[1].text == docs[0][1] and len(out[2].text.split()) == 60


def test_sums_do_not_depend_on_their_order(spark):
    from lumenset.llm.mixing import exact_sum

    draw = random.Random(6)
    values = [(draw.random() * 10 ** draw.randrange(-6, 9),) for _ in range(5000)]
    sums = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        sums.add(spark.createDataFrame(values, "x double").repartition(3 + seed).agg(exact_sum(F.col("x"))).first()[0])
    assert len(sums) == 1
