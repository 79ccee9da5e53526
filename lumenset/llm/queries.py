"""Registered queries of the operators for training data, and the SQL that checks them where SQL can."""

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.tables import read
from . import ann, article, hilbert, leaks, lines, middles, mixing, neardup, packing, periods, rules, spans, token_files

WORD = r"[^\x20\x09-\x0D]+"


def op7_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    kept = lines.drop_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
    with split as (
        select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place
        from documents),
    keyed as (
        select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
        from split),
    owners as (
        select key, min(doc_id) as owner from keyed where length(key) >= 10
        group by key having min(doc_id) < max(doc_id))
    select doc_id, count(*) as n_lines, count(owner) filter (owner <> doc_id) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by place) filter (owner is null or owner = doc_id), '')) as kept_sha256
    from keyed left join owners using (key) group by doc_id"""

def op1_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


def op2_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    kept = spans.drop_repeated_spans(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
    with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
    windows as (
        select doc_id, unnest(range(1, len(words) - 33)) as start, words from texts where len(words) >= 35),
    hashed as (select doc_id, start, md5(array_to_string(words[start : start + 34], ' ')) as h from windows),
    again as (select h from hashed group by h having count(*) > 1),
    gone as (select distinct doc_id, start + unnest(range(0, 35)) as place from hashed join again using (h)),
    spread as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from texts),
    kept as (
        select spread.doc_id, count(*) filter (gone.place is not null) as n_removed,
               string_agg(word, ' ' order by spread.place) filter (gone.place is null) as kept
        from spread left join gone on spread.doc_id = gone.doc_id and spread.place = gone.place group by 1)
    select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
    from texts left join kept using (doc_id)"""

def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(read(spark, folder, "documents"))


def op5_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(read(spark, folder, "documents"))


OP5_SQL = r"""
    with recursive texts as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') as words
        from documents),
    shingles as (
        select distinct doc_id, array_to_string(words[i : i + 4], ' ') as shingle
        from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from texts where len(words) > 0)),
    sizes as (select doc_id, count(*) as n from shingles group by 1),
    shared as (
        select x.doc_id as a, y.doc_id as b, count(*) as common
        from shingles x join shingles y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by 1, 2),
    links as (
        select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
        where 100 * common >= 75 * (x.n + y.n - common)),
    reach as (
        select doc_id as a, doc_id as b from documents
        union select reach.a, links.b from reach join links on reach.b = links.a)
    select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
    from (select a as doc_id, min(b) as component_id from reach group by 1) left join sizes using (doc_id)"""

def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read(spark, folder, "documents"))


def op6_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    placed = hilbert.hilbert_shards(read(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mixing.document_copies(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_article(spark: SparkSession, folder: str) -> DataFrame:
    return article.extract_articles(read(spark, folder, "pages").select("page_id", "url", "html"))


def op10_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    learned = rules.fit_rules(docs, read(spark, folder, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.judge(docs, learned).select(*columns)


def planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document, by its id's checksum, with the words from some place on replaced by a repetition of the first of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, g = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.floor(h / 10)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.concat(F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))), F.lit(1), n)
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(F.col("text")))


def op11_periods(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = periods.collapse_runs(planted_periods(docs))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines_ = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(lines_, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words",
    )


def op12_middles(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    back = middles.restore_middle(middles.fill_in_middle(docs), with_text=False)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("sha256").alias("output_sha256"), "restored_sha256")


OP12_SQL = r"""
    with drawn as (
        select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t,
               [cast('0x' || substr(sha256('1:' || coalesce(doc_id::varchar, '')), 8 * i + 1, 8) as bigint) for i in range(4)] as h
        from documents),
    cut as (
        select *, least(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) as low, greatest(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) as high,
               case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain'
                    when h[4] % 100 < 20 then 'spm' else 'psm' end as form
        from drawn),
    parts as (
        select *, array_to_string(t[1 : low], '') as p, array_to_string(t[low + 1 : high], '') as m, array_to_string(t[high + 1 : len(t)], '') as s from cut)
    select doc_id, cast(len(t) as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
           case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
           sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                  else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
           sha256(text) as restored_sha256
    from parts"""


def op13_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


OP13_SQL = r"""
    with docs as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from documents),
    items as (
        select coalesce(item_id::varchar, '') as item_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
        from benchmark),
    windows as (
        select distinct item_id, size, array_to_string(w[i : i + size - 1], ' ') as words
        from (select *, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)),
    sizes as (select distinct size from windows),
    places as (
        select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as words
        from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs join sizes on len(w) >= size)),
    found as (select doc_id, i, places.size, item_id from places join windows using (words)),
    hits as (
        select doc_id, count(distinct place) as n_hit
        from (select doc_id, unnest(range(i, i + size)) as place from (select distinct doc_id, i, size from found)) group by 1),
    named as (
        select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
        from (select distinct doc_id, item_id from found) group by 1)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
    from docs left join hits using (doc_id) left join named using (doc_id)"""


QUERIES = {
    "op1_ann": op1_ann, "op2_spans": op2_spans, "op3_packing": op3_packing, "op4_token_files": op4_token_files, "op5_neardup": op5_neardup, "op6_hilbert": op6_hilbert,
    "op7_lines": op7_lines, "op8_mixing": op8_mixing, "op9_article": op9_article, "op10_rules": op10_rules,
    "op11_periods": op11_periods, "op12_middles": op12_middles, "op13_leaks": op13_leaks,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op2_spans": OP2_SQL, "op5_neardup": OP5_SQL, "op7_lines": OP7_SQL, "op12_middles": OP12_SQL, "op13_leaks": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
