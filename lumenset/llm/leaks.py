"""Benchmark decontamination as a prefix-filtered containment join of word windows.

The sets on the left are the windows of benchmark items, the elements are shingles of ``SHINGLE`` words, ordered by how rare they are
in the documents. A document can hold a window only if it holds all its shingles, so the necessary prefix is the
rarest one alone, and a window with a shingle that no document has goes at once. Documents are read once for the counts and
once for the places of prefix shingles, both behind a bitmap of fixed size. A place and the shingle's place in the window tell
where the window would begin; what would begin before the document or end behind it goes, and the words of the rest are compared.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.kinds import quoted
from .frames import binary, bound_batches, stored, text_rows
from .words import as_long, hash_words, segments_of, window_hashes

WINDOW = 10
SHINGLE = 4
# Bits of the bitmap per shingle, and at most: beyond that the bitmap only lets more through.
BITS_EACH = 64
MOST_BITS = 1 << 27

# What parts words: all ASCII but digits and letters. Capitals become small.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    return text.translate(_TABLE).split()


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and where each begins in ``hashes``."""
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(text[: max(len(hashes) - size + 1, 0)] == text[size - 1 :])
    return window_hashes(hashes, start, size), start


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """(item, words, size, shingles): the distinct windows of each item; an item of fewer words is one window."""
    rows = items.select(F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("_item"), quoted(text_col).cast("string").alias("_text"))

    def cut(batches):
        for batch in batches:
            out = {"item": [], "words": [], "size": [], "shingles": []}
            for item, text in zip(batch["_item"].to_pylist(), binary(batch["_text"])):
                words = split_words(text or b"")
                size = min(window, len(words))
                if not size:
                    continue
                width = min(shingle, size)
                hashes, counts = hash_words([b" ".join(words)])
                found = as_long(shingle_hashes(hashes, counts, width)[0])
                for at in range(len(words) - size + 1):
                    out["item"].append(item)
                    out["words"].append(b" ".join(words[at : at + size]))
                    out["size"].append(size)
                    out["shingles"].append(found[at : at + size - width + 1])
            columns = [pa.array(out["item"], pa.string()), pa.array(out["words"], pa.binary()).cast(pa.string())]
            columns += [pa.array(out["size"], pa.int32()), pa.array(out["shingles"], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, list(out))

    return rows.mapInArrow(cut, "item string, words string, size int, shingles array<bigint>").dropDuplicates(["item", "words"])


class Sieve:
    """A bitmap of shingles for the documents' tasks; its size is fixed, whatever the benchmark's."""

    def __init__(self, shingles: DataFrame):
        """``shingles`` has distinct values in one column."""
        n = shingles.count()
        self.bits = min(max(1 << 16, 1 << (BITS_EACH * n).bit_length()), MOST_BITS)
        name = shingles.columns[0]
        bit = F.col(name).bitwiseAND(self.bits - 1)
        cells = shingles.select(F.shiftright(bit, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("bit"))
        found = cells.groupBy("cell").agg(F.bit_or("bit").alias("word")).toArrow()
        words = np.zeros(self.bits >> 6, dtype=np.int64)
        words[found["cell"].to_numpy()] = found["word"].to_numpy()
        self._sent = shingles.sparkSession.sparkContext.broadcast(words)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        words = self._sent.value.view(np.uint64)
        return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def count_shingles(docs: DataFrame, sieve: Sieve, widths: list[int]) -> DataFrame:
    """(shingle, n): how often the documents hold what passes the sieve."""

    def count(batches):
        for batch in batches:
            hashes, counts = hash_words([t or b"" for t in binary(batch["_text"])], split_words)
            found = [shingle_hashes(hashes, counts, width)[0] for width in widths]
            found, n = np.unique(np.concatenate([f[sieve.holds(f)] for f in found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(found)), pa.array(n)], ["shingle", "n"])

    return docs.select("_text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def words_around(text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """Words lo to hi of a text, joined by one space, for many ranges at once; no more of its words are held."""
    steps = np.zeros(int(hi.max(initial=0)) + 1, dtype=np.int64)
    np.add.at(steps, lo, 1)
    np.add.at(steps, hi, -1)
    wanted = np.flatnonzero(np.cumsum(steps) > 0)
    words, at = [], 0
    for part in segments_of(text, split_words):
        a, b = np.searchsorted(wanted, (at, at + len(part)))
        words += [part[i - at] for i in wanted[a:b].tolist()]
        at += len(part)
    first, last = np.searchsorted(wanted, lo), np.searchsorted(wanted, hi)
    return [b" ".join(words[a:b]) for a, b in zip(first.tolist(), last.tolist())]


def mark_documents(docs: DataFrame, sieve: Sieve, widths: list[int], window: int) -> DataFrame:
    """(_id, hi, lo, n_words, places): a 128-bit key of the text, and the places of what passes the sieve.

    A place has the shingle, its first word, and the words around it with the number of those before it.
    """
    place = pa.struct([("shingle", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("around", pa.string())])

    def mark(batches):
        for batch in batches:
            texts = [t or b"" for t in binary(batch["_text"])]
            hashes, counts = hash_words(texts, split_words)
            begins = np.cumsum(counts) - counts
            shingles, starts, sizes = [], [], []
            for width in widths:
                found, start = shingle_hashes(hashes, counts, width)
                held = sieve.holds(found)
                shingles.append(found[held])
                starts.append(start[held])
                sizes.append(np.full(int(held.sum()), width))
            shingles, starts, sizes = np.concatenate(shingles), np.concatenate(starts), np.concatenate(sizes)
            order = np.argsort(starts, kind="stable")
            shingles, starts, sizes = shingles[order], starts[order], sizes[order]
            # texts without words begin where the next one does
            ends = np.searchsorted(starts, begins + counts, side="left")
            firsts = np.searchsorted(starts, begins, side="left")
            around, lead, at = [], np.zeros(len(starts), dtype=np.int32), np.zeros(len(starts), dtype=np.int64)
            for i in np.flatnonzero(ends > firsts).tolist():
                a, b = firsts[i], ends[i]
                at[a:b] = starts[a:b] - begins[i]
                lo = np.maximum(at[a:b] - (window - sizes[a:b]), 0)
                lead[a:b] = at[a:b] - lo
                around += words_around(texts[i], lo, np.minimum(at[a:b] + window, counts[i]))
            fields = [pa.array(as_long(shingles)), pa.array(at), pa.array(lead), pa.array(around, pa.binary()).cast(pa.string())]
            places = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(starts)), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(place)))
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), dtype=np.int64).reshape(-1, 2)
            columns = [batch["_id"], pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(counts), places]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "hi", "lo", "n_words", "places"])

    schema = "_id bigint, hi bigint, lo bigint, n_words bigint, places array<struct<shingle:bigint,at:bigint,lead:int,around:string>>"
    return docs.select("_id", "_text").mapInArrow(mark, schema)


def covered(places: list, window: int) -> int:
    """Words that any of the windows (first word * (window + 1) + size) holds."""
    codes = np.sort(np.asarray(places, dtype=np.int64))
    start, end = codes // (window + 1), np.maximum.accumulate(codes // (window + 1) + codes % (window + 1))
    fresh = end - np.maximum(start, np.append(0, end[:-1]))
    return int(np.maximum(fresh, 0).sum())


def _digest(ids: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(ids), ","), 256)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """Which documents hold windows of benchmark items.

    Words are runs of digits, letters and code points from 0x80, A-Z lower-cased. A window is ``window`` consecutive words of an
    item; an item of fewer words, but not none, is one window. Every word of a document inside any occurrence of a window is hit.

    Returns one row per row of ``docs``: its id, ``n_words``, ``n_hit``, ``n_items`` (items with occurring windows), ``items_sha256`` (of those
    items' ids, sorted as texts and joined by commas) and ``contaminated`` (any word hit). Other columns of either table
    play no part, whatever their names. A null, empty or wordless text is clean; items of such texts never occur. Documents
    without an id and repeated rows are judged like others; rows of one item id are one item, items without
    an id are one item of an empty id. Without items all documents are clean; without documents there are no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = text_rows(docs, id_col, text_col)
    windows = stored(item_windows(items, item_id, item_text, window, shingle), "windows")
    distinct = windows.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    single = distinct.select("words", "size", F.posexplode("shingles").alias("offset", "shingle"))
    widths = sorted(r[0] for r in windows.select(F.least("size", F.lit(shingle))).distinct().collect()) or [shingle]
    counts = stored(count_shingles(rows, Sieve(single.select("shingle").distinct()), widths), "counts")
    # the necessary prefix of a window: its rarest shingle; no document holds a window with a shingle that none has
    ranked = single.join(counts, "shingle", "left").groupBy("words").agg(
        F.first("size").alias("size"), F.min(F.coalesce("n", F.lit(0))).alias("n"), F.min_by(F.struct("shingle", "offset"), F.struct("n", "offset")).alias("prefix")
    )
    prefixes = stored(ranked.filter("n > 0").select("words", "size", "prefix.*"), "prefixes")
    marked = stored(mark_documents(rows, Sieve(prefixes.select("shingle").distinct()), widths, window), "marked")

    places = marked.filter(F.size("places") > 0).select("hi", "lo", "n_words", F.explode("places").alias("p")).select("hi", "lo", "n_words", "p.*")
    start = F.col("at") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("size")), " ") == F.col("words")
    found = places.join(prefixes, "shingle").filter(bounds).filter(same)
    code = start * (window + 1) + F.col("size")
    held = stored(found.groupBy("hi", "lo").agg(F.collect_set(code).alias("codes"), F.collect_set("words").alias("words")), "held")

    # documents that hold the same windows hold the same items, which are listed once for all of them
    kinds = held.select("hi", "lo", "codes", F.array_sort("words").alias("words")).withColumn("kind", F.sha2(F.array_join("words", "\n"), 256))
    listed = kinds.groupBy("kind").agg(F.first("words").alias("words")).select("kind", F.explode("words").alias("words"))
    named = listed.join(windows.select("words", "item"), "words").groupBy("kind").agg(F.collect_set("item").alias("items"))
    named = named.select("kind", F.size("items").cast("long").alias("n_items"), _digest(F.col("items")).alias("items_sha256"))
    hit = F.udf(lambda codes: covered(codes, window), "bigint", useArrow=True)
    leaks = stored(kinds.select("hi", "lo", "kind", hit("codes").alias("n_hit")).join(named, "kind").drop("kind"), "leaks")

    none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.lit(hashlib.sha256().hexdigest())}
    touched = marked.filter(F.size("places") > 0).drop("places").join(leaks, ["hi", "lo"], "left").withColumns({k: F.coalesce(k, v) for k, v in none.items()})
    clean = marked.filter(F.size("places") == 0).drop("places").withColumns(none)
    whole = touched.select(*clean.columns).unionByName(clean)
    id_kind = docs.schema[id_col].dataType
    return whole.select(F.col("_id").cast(id_kind).alias(id_col), "n_words", *none, (F.col("n_hit") > 0).alias("contaminated"))


def leaks_by_brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """(id, words, hit, items, SHA-256 of their ids, contaminated) of (id, text) rows, in plain Python; for tests."""
    held = {}
    for item, text in items:
        words = split_words((text or "").encode())
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            held.setdefault(tuple(words[at : at + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in held}
    out = []
    for doc, text in docs:
        words = split_words((text or "").encode())
        hit, names = set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                if (found := held.get(tuple(words[at : at + size]))) is not None:
                    hit.update(range(at, at + size))
                    names |= found
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
