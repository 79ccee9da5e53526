"""Near-duplicate groups: MinHash bands propose, a sequential Bayesian test prunes, full sets confirm.

1. Documents of equal shingle sets are one class; only its smallest id goes on, whatever the number of copies.
2. Bands of the class signatures form buckets. Every member of a bucket is compared with the bucket's
   smallest member only, so a bucket of thousands yields as many pairs as members.
3. Pairs are read in batches of hashes. After each batch the posterior of the similarity, Beta from a uniform
   prior, prunes the pair if a similarity at the threshold is less likely than ``miss``.
4. Survivors are confirmed on their full shingle sets, and links become components.
5. Buckets that still hold several components are compared whole, in tiles, between components only;
   so no candidate pair is left out, and pairs inside a component are never made.
"""

from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import binary, bound_batches, opened, packed, stored, text_rows
from .words import as_long, encoded, hash_words, mix, shingles

SHINGLE = 5
BANDS = 32
ROWS = 4
HASHES = BANDS * ROWS
BATCH = 16
TILE = 1024
# Bytes of shingle sets that a task keeps.
SET_BYTES = 200 << 20
MISS = 1e-6

_random = np.random.default_rng(75)
_TIMES = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64)


# Sets and signatures


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and their number by text."""
    words, counts = hash_words([t.lower() for t in texts])
    hashes, of = shingles(words, counts, n)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.bincount(of[new], minlength=len(texts))


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The upper 16 bits of HASHES least hashes of every set; zeros for empty sets."""
    out = np.zeros((len(sizes), HASHES), dtype=np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        begins = (np.cumsum(sizes) - sizes)[full]
        # a few thousand hashes at a time stay in the processor's cache
        cuts = np.unique(np.searchsorted(begins, np.arange(0, begins[-1] + 1, 1 << 15)))
        for a, b in zip(cuts, [*cuts[1:], len(full)]):
            end = begins[b] if b < len(full) else len(hashes)
            part = hashes[begins[a] : end]
            for i in range(HASHES):
                least = np.minimum.reduceat(mix_with(part, i), begins[a:b] - begins[a])
                out[full[a:b], i] = (least >> np.uint64(48)).astype(np.uint16) ^ (least >> np.uint64(24)).astype(np.uint16)
    return out


def mix_with(x: np.ndarray, i: int) -> np.ndarray:
    return (x ^ _XOR[i]) * _TIMES[i]


def _set_keys(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set; equal sets have equal sums."""
    keys = []
    for salt in (0x1234567, 0x89ABCDEF):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        keys.append(as_long(total[ends] - total[ends - sizes]))
    return keys


# The sequential test


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For every number of hashes read: the fewest matches with which a pair goes on.

    With m of k hashes equal the similarity is Beta(m + 1, k - m + 1); the pair goes on while
    P(similarity >= threshold) >= miss.
    """
    out = {}
    for k in range(BATCH, HASHES + 1, BATCH):
        for m in range(k + 1):
            # P(Beta(m + 1, k - m + 1) >= t) = P(Binomial(k + 1, t) <= m)
            terms = [
                lgamma(k + 2) - lgamma(j + 1) - lgamma(k + 2 - j) + j * log(threshold) + (k + 1 - j) * log(1 - threshold)
                for j in range(m + 1)
            ]
            top = max(terms)
            if log(sum(np.exp(t - top) for t in terms)) + top >= log(miss):
                out[k] = m
                break
    return out


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, needed: dict[int, int]) -> np.ndarray:
    """Which of the pairs (left[i], right[j]) of signatures pass every batch; later batches read the remaining pairs only."""
    at = np.arange(len(i))
    matches = np.zeros(len(i), dtype=np.int64)
    for k in sorted(needed):
        batch = slice(k - BATCH, k)
        matches = matches + (left[i[at], batch] == right[j[at], batch]).sum(axis=1)
        going = matches >= needed[k]
        at, matches = at[going], matches[going]
    return at


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, HASHES)


# Components


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one parent, and no parent has one."""
    parents = edges.select(F.col("b").alias("parent")).distinct()
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    return n == nodes and edges.join(parents, F.col("a") == F.col("parent"), "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id it is linked with over any number of links (``a``, ``b``).

    Alternating star rounds: neighbours above a node move to its smallest neighbour, then those below, until only stars
    around smallest ids are left; the number of rounds grows with the logarithm of the largest component. Two counts per round
    reach the driver.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, F.col("a") == F.col("node")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), "large")
        least = stored(large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), "least")
        small = large.join(least, F.col("a") == F.col("node"))
        down = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = stored(down.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


# Pairs


def tested(pairs: DataFrame, reps: DataFrame, needed: dict[int, int], threshold: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sizes and signatures leave the threshold possible."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold)

    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                going = pa.array(survivors(_matrix(batch["sig_a"]), _matrix(batch["sig_b"]), every, every, needed))
                yield pa.RecordBatch.from_arrays([batch["a"].take(going), batch["b"].take(going)], ["a", "b"])

    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a long, b long")


def first_shared_band(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first band in which two signatures are equal, for rows of signatures that share one."""
    return (left == right).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)


def is_close(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sets, as arrays of distinct hashes, have the similarity."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return len(both) > 0 and 100 * shared >= threshold * (len(both) - shared)


class _Sets:
    """Shingle sets of packed texts, made when asked for; a bounded number of bytes is kept."""

    def __init__(self, blobs: pa.Array):
        self.blobs, self.kept, self.size = blobs, {}, 0

    def __getitem__(self, at: int) -> np.ndarray:
        if at not in self.kept:
            made, _ = shingle_sets([t or b"" for t in opened(self.blobs.slice(at, 1))])
            if self.size + made.nbytes > SET_BYTES:
                self.kept, self.size = {}, 0
            self.kept[at] = made
            self.size += made.nbytes
        return self.kept[at]


def tiled(members: DataFrame, reps: DataFrame, texts: DataFrame, needed: dict[int, int], threshold: int) -> DataFrame:
    """Links between members (``bucket``, ``band``, ``id``, ``component``, ``size`` of the bucket) of one bucket and different components.

    A large bucket is cut into blocks of about TILE members, and every two blocks meet in a task of their own. A pair
    is looked at in the bucket of the first band it shares only. Sets come along with the members, so
    pairs that pass the test are confirmed on the spot and no pair but a link leaves the task.
    """
    blocks = F.ceil(F.col("size") / TILE)
    block = F.pmod(F.xxhash64("id"), blocks)
    sets = reps.select("id", "n", "sig").join(texts.select(F.col("_id").alias("id"), "_blob"), "id")
    wanted = members.select("id").distinct()
    signed = members.join(sets.join(wanted, "id", "left_semi"), "id").withColumn("block", block)
    signed = signed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    signed = signed.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    key = ["bucket", "lo", "hi"]
    laid = signed.select(*key, "block", "band", "id", "component", "n", "sig", "_blob").repartition(*key).sortWithinPartitions(*key)

    def compare(table):
        keys = np.stack([table[c].to_numpy() for c in key])
        block, band, ids, component, n = (table[c].to_numpy() for c in ("block", "band", "id", "component", "n"))
        lo, hi = keys[1], keys[2]
        matrix = _matrix(table["sig"].combine_chunks())
        sets = _Sets(table["_blob"].combine_chunks())
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            for first in range(a, b, 128):  # a strip of 128 members against the rest of the tile
                i, j = np.meshgrid(np.arange(first, min(first + 128, b)), np.arange(first, b), indexing="ij")
                i, j = i.ravel(), j.ravel()
                apart = (i < j) & (component[i] != component[j]) & ((lo[a] == hi[a]) | (block[i] != block[j]))
                apart &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * threshold
                i, j = i[apart], j[apart]
                at = survivors(matrix, matrix, i, j, needed)
                i, j = i[at], j[at]
                here = first_shared_band(matrix[i], matrix[j]) == band[a]
                links = [(ids[x], ids[y]) for x, y in zip(i[here], j[here]) if is_close(sets[x], sets[y], threshold)]
                if links:
                    x, y = np.array(links).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def stream(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            if not held.num_rows:
                continue
            same = np.ones(held.num_rows, dtype=bool)
            for c in key:
                same &= held[c].to_numpy() == held[c][-1].as_py()
            cut = int(np.argmax(same))
            if cut:
                yield from compare(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from compare(held)

    return stored(laid.mapInArrow(stream, "a long, b long"), "tile-links")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets have the similarity; ``texts`` are packed texts by ``_id``."""
    pairs = stored(pairs.distinct(), "pairs")
    right = texts.select(F.col("_id").alias("b"), F.col("_blob").alias("right"))
    left = texts.select(F.col("_id").alias("a"), F.col("_blob").alias("left"))
    # a hub has many partners: its text joins last, so that its rows are neighbours and its set is made once
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")

    def confirm(batches):
        for batch in batches:
            blobs = batch["left"].to_pylist() + batch["right"].to_pylist()
            place = {}
            at = [place.setdefault(blob, len(place)) for blob in blobs]
            hashes, sizes = shingle_sets([t or b"" for t in opened(pa.array(list(place), pa.binary()))])
            sets = np.split(hashes, np.cumsum(sizes)[:-1]) if len(sizes) else []
            close = np.zeros(batch.num_rows, dtype=bool)
            for row in range(batch.num_rows):
                close[row] = is_close(sets[at[row]], sets[at[row + batch.num_rows]], threshold)
            going = pa.array(np.flatnonzero(close))
            yield pa.RecordBatch.from_arrays([batch["a"].take(going), batch["b"].take(going)], ["a", "b"])

    return stored(both.mapInArrow(confirm, "a long, b long").distinct(), "links")


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75, miss: float = MISS
) -> DataFrame:
    """One row per row of ``docs``: its id under its own name, ``n_shingles``, ``component_id`` and ``kept``.

    Words are runs of bytes other than space and 0x09-0x0D after A-Z became lower case; a set holds the distinct
    runs of five words, or the whole of a shorter text. Documents are linked at a Jaccard similarity of ``threshold``
    percent or more; ``component_id`` is the smallest id that links reach, and ``kept`` says whether it is the row's own.

    Null, empty and blank texts have no shingle, are linked with nothing and kept. Rows without an id are linked with
    nothing, have no component and are kept. Rows of one id are linked with each other. An empty table gives none.
    """
    bound_batches(docs.sparkSession)
    rows = text_rows(docs.select(id_col, text_col), id_col, text_col)
    needed = least_matches(threshold / 100, miss)

    def sets(batches):
        for batch in batches:
            hashes, sizes = shingle_sets(encoded(binary(batch["_text"])))
            signed = signatures(hashes, sizes)
            columns = [batch["_id"], pa.array(sizes, pa.int64()), *[pa.array(k, pa.int64()) for k in _set_keys(hashes, sizes)]]
            columns.append(pa.array([s.tobytes() for s in signed], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "k1", "k2", "sig"])

    signed = stored(rows.select("_id", "_text").mapInArrow(sets, "id long, n long, k1 long, k2 long, sig binary"), "sets")
    known = signed.filter("id is not null and n > 0")
    same = ["k1", "k2", "n"]
    classes = stored(known.groupBy(*same).agg(F.min("id").alias("rep")), "classes")
    classed = stored(known.select("id", *same).join(classes, same).select("id", "n", "rep"), "classed")
    first = known.join(classes.select(F.col("rep").alias("id"), *same), ["id", *same], "left_semi")
    reps = stored(first.dropDuplicates(["id", *same]).select("id", "n", "sig"), "reps")

    def bands(batches):
        for batch in batches:
            values = _matrix(batch["sig"]).astype(np.uint64).reshape(-1, BANDS, ROWS)
            keys = np.zeros(values.shape[:2], dtype=np.uint64)
            for i in range(ROWS):
                keys = (keys << np.uint64(16)) | values[:, :, i]
            keys = mix(keys ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :])
            ids = np.repeat(batch["id"].to_numpy(), BANDS)
            numbers = np.tile(np.arange(BANDS, dtype=np.int32), len(values))
            columns = [pa.array(as_long(keys.ravel()), pa.int64()), pa.array(numbers), pa.array(ids, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "band", "id"])

    members = reps.select("id", "sig").mapInArrow(bands, "bucket long, band int, id long")
    hubs = members.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last")
    members = stored(members.join(stored(hubs.select("bucket", "hub"), "hubs"), "bucket"), "members")
    texts = packed(rows.filter("_id is not null").select("_id", "_text"))
    pairs = stored(members.filter("hub < id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "hub-pairs")
    links = confirmed(tested(pairs, reps, needed, threshold), texts, threshold)
    # an id with several texts belongs to several classes: they are one component
    spread = classed.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a < last").select("id", "a")
    links = links.unionByName(classed.join(spread, "id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct())
    labels = components(links)
    labelled = members.select("bucket", "band", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = stored(labelled.distinct(), "labelled")
    split = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    split = stored(split.filter("lo < hi").select("bucket", "size"), "split")
    across = tiled(stored(labelled.join(split, "bucket"), "open"), reps, texts, needed, threshold)
    labels = components(links.unionByName(across))
    found = classed.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select("id", "n", F.coalesce("component", "rep").alias("component"))
    alone = signed.filter("id is null or n = 0").select("id", "n", F.col("id").alias("component"))
    kind = docs.schema[id_col].dataType
    return found.unionByName(alone).select(
        F.col("id").cast(kind).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").cast(kind).alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest id of each group (see near_duplicate_groups)."""
    groups = near_duplicate_groups(docs, id_col, text_col, threshold)
    away = stored(groups.filter("not kept").select(F.col(id_col).alias("_away")).distinct(), "copies")
    return docs.join(away, docs[id_col] == away["_away"], "left_anti")


def groups_by_brute_force(docs: list[tuple], threshold: int = 75) -> list[tuple]:
    """(id, set size, component) of (id, text) rows with distinct ids, in plain Python; for tests."""
    sets = {}
    for doc, text in docs:
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()
    component = {doc: doc for doc in sets}

    def root(x):
        while component[x] != x:
            x = component[x]
        return x

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= threshold * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                component[y] = x
    return [(doc, len(sets[doc]), root(doc)) for doc in ids]
