"""Approximate nearest neighbours by inner product: lists of rotated vectors, scanned in column blocks.

Inner products become distances by one more coordinate that gives every vector the same length. A random
rotation spreads the length of a difference evenly over the coordinates, so the distance over the first few
blocks of columns tells about the whole: a candidate is abandoned as soon as the hypothesis that it is nearer
than the best found so far can be rejected (adaptive dimension scan). What survives all blocks gets its exact score.

Vectors are assigned to lists around centroids fitted on a bounded sample; every vector is in one list. A list
is scanned in blocks of rows, each with a block of the queries that probe it, so no list or query group meets in
one task. Equal vectors are one candidate with its smallest ids, and equal queries are searched once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kinds import quoted
from .frames import stored

# Vectors on which centroids are fitted (the smallest hashes), rows per list, and the most lists: bounds of what the driver holds.
SAMPLE = 20_000
ROWS_PER_LIST = 1_024
MOST_LISTS = 2_048
# Share of the lists that a query probes, nearest first.
PROBES = 0.8
# Rows and queries that meet in one task.
BLOCK = 4_096
# Columns per block, and how many standard deviations reject a candidate.
COLUMNS = 16
SIGNIFICANCE = 2.1
# Vectors longer than so many times the length that 99 % of vectors have at most are scored exactly, outside the lists.
OUTSIZE = 8.0


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate that makes every vector as long as the longest: the nearest then has the largest inner product."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
    return np.hstack([vectors, rest[:, None]])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, which rank candidates alike; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, initial=0.0, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def best_exact(queries: np.ndarray, candidates: np.ndarray, k: int):
    """For each query the places and scores of the k candidates of largest inner product, ties at the end included."""
    for number, query in enumerate(queries):
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (candidates * query).sum(axis=1)
        least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
        at = np.flatnonzero(~(scores < least))
        yield number, at, scores[at]


def fit_centroids(vectors: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """k-means from evenly spread members of the sample."""
    lists = max(1, min(lists, len(vectors)))
    centroids = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        nearest = assign(vectors, centroids)
        many = np.bincount(nearest, minlength=lists)
        order = np.argsort(nearest, kind="stable")
        filled = np.flatnonzero(many)
        begins = np.cumsum(many) - many
        sums = np.add.reduceat(vectors[order], begins[filled], axis=0)
        centroids[filled] = sums / many[filled][:, None]
    return centroids


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances but for the length of the vectors, which does not change an order."""
    return (centroids**2).sum(axis=1)[None, :] - 2 * vectors @ centroids.T


def assign(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(vectors[a : a + 4096], centroids).argmin(axis=1) for a in range(0, len(vectors), 4096)])


def adaptive_scan(queries: np.ndarray, candidates: np.ndarray, k: int, bounds: np.ndarray | None = None):
    """For each rotated query the places of candidates that may be among its k nearest.

    Candidates lie in blocks of COLUMNS columns. The k-th best distance starts from ``bounds``, or from the first 4 k candidates, and
    falls as chunks are read. After d of D columns a candidate goes on if partial * D / d <= best * (1 + SIGNIFICANCE / sqrt(d)) ** 2.
    """
    dims = candidates.shape[1]
    cuts = [*range(0, dims, COLUMNS), dims]
    blocks = [np.ascontiguousarray(candidates[:, a:b]) for a, b in zip(cuts, cuts[1:])]
    lengths = [(x**2).sum(axis=1) for x in blocks]
    chunk = 1024
    for number, query in enumerate(queries):
        kept, found = [], []
        best = np.inf if bounds is None else bounds[number]
        for begin in [0, *range(4 * k, len(candidates), chunk)]:
            at = np.arange(begin, min(begin + chunk if begin else 4 * k, len(candidates)))
            partial = np.zeros(len(at))
            for x, own, a, b in zip(blocks, lengths, cuts, cuts[1:]):
                part = query[a:b]
                rows = slice(at[0], at[-1] + 1) if len(at) and len(at) == at[-1] - at[0] + 1 else at
                partial = partial + own[rows] - 2 * (x[rows] @ part) + part @ part
                going = partial * (dims / b) <= best * (1 + SIGNIFICANCE / np.sqrt(b)) ** 2 if b < dims else partial <= best * (1 + 1e-9) + 1e-12
                if not going.all():
                    at, partial = at[going], partial[going]
                if not len(at):
                    break
            if len(at):
                kept.append(at)
                found.append(partial)
                seen = np.concatenate(found)
                if len(seen) > k:
                    best = np.partition(seen, k - 1)[k - 1]
        if kept:
            at, seen = np.concatenate(kept), np.concatenate(found)
            yield number, at[seen <= best * (1 + 1e-9) + 1e-12]


def _matrix(column, dims: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probes: float = PROBES
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the id under its own name, and ``score``: the ``k`` vectors of largest inner product with each query.

    ``queries`` has the columns of ``vectors``. A query's own id is no candidate of it. Scores are inner products of the
    vectors as given, in double precision; ties go to the smaller id. Every query gets ``k`` rows, or as many as there are
    candidates: it probes at least the share ``probes`` of the lists, and more until they hold enough.

    Rows without an id, and vectors that are null, empty, zero or of another length than most, or hold null or non-finite components,
    take no part. Rows that share an id and a vector are one; rows that share an id only are candidates of their own. Vectors far
    longer than others (``OUTSIZE``) are in no list and are scored exactly for every query; a score beyond doubles is infinite.
    An empty table gives none.
    """
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        v = F.transform(quoted(vector_col), lambda x: x.cast("double"))
        rows = df.select(quoted(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))

    def with_key(df: DataFrame) -> DataFrame:
        # adding zero makes the two zeros one
        return df.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("key", F.sha2(F.to_binary(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), F.lit("utf-8")), 256))

    rows = valid(vectors)
    common = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    kind = vectors.schema[id_col].dataType
    shape = f"query_id {kind.simpleString()}, rank int, `{id_col}` {kind.simpleString()}, score double"
    if common is None:
        return spark.createDataFrame([], shape)
    dims = common["dims"]
    rows = with_key(rows.filter(F.size("v") == dims))
    asked = with_key(valid(queries).filter(F.size(quoted("v")) == dims)).select("id", "key", "v").dropDuplicates(["id", "key"])
    # of equal vectors the k + 1 smallest ids are enough for any query, its own excluded
    equal = Window.partitionBy("key").orderBy("id")
    members = rows.select("key", "id").distinct().withColumn("at", F.row_number().over(equal)).filter(F.col("at") <= k + 1)
    members = stored(members.select("key", "id"), "members")
    distinct = stored(rows.dropDuplicates(["key"]).select("key", "v"), "vectors")
    # scaled by the largest component, so that no square overflows
    most = F.array_max(F.transform("v", F.abs))
    length = most * F.sqrt(F.aggregate(F.transform("v", lambda x: x / most), F.lit(0.0), lambda a, x: a + x * x))
    measured = distinct.select("key", "v", length.alias("length"))
    usual = OUTSIZE * measured.agg(F.percentile_approx("length", 0.99, 10_000)).first()[0]
    longest, total = measured.filter(F.col("length") <= usual).agg(F.max("length"), F.count(F.lit(1))).first()
    sample = measured.filter(F.col("length") <= usual).orderBy("key").limit(SAMPLE).collect()
    turn = rotation(dims + 1)
    lists = min(MOST_LISTS, max(8, -(-total // ROWS_PER_LIST)))
    centroids = fit_centroids(lengthened(np.array([r["v"] for r in sample]), longest) @ turn, lists)
    lists = len(centroids)  # the outsize vectors are one more

    def to_lists(batches):
        for batch in batches:
            if batch.num_rows:
                place = np.full(batch.num_rows, lists)
                own = batch["length"].to_numpy() <= usual
                if own.any():
                    place[own] = assign(lengthened(_matrix(batch["v"], dims)[own], longest) @ turn, centroids)
                yield pa.RecordBatch.from_arrays([batch["key"], batch["v"], pa.array(place, pa.int32())], ["key", "v", "list"])

    listed = stored(measured.mapInArrow(to_lists, "key string, v array<double>, list int"), "lists")
    sizes = np.zeros(lists + 1, dtype=np.int64)
    for r in listed.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    row_blocks = np.maximum(1, -(-sizes // BLOCK))

    def to_probes(batches):
        for batch in batches:
            if batch.num_rows:
                # a query has the length 0 in the added coordinate
                turned = np.hstack([unit(_matrix(batch["v"], dims)), np.zeros((batch.num_rows, 1))]) @ turn
                order = np.argsort(distances(turned, centroids), axis=1, kind="stable")
                if sizes[lists]:  # all ask for the outsize vectors, and first
                    order = np.hstack([np.full((batch.num_rows, 1), lists), order])
                held = np.cumsum(sizes[order], axis=1)
                most = np.maximum(np.ceil(probes * lists), 1 + (held < k + 1).sum(axis=1)).astype(int)
                most = np.minimum(most, order.shape[1])
                of = np.repeat(np.arange(batch.num_rows), most)
                to = np.concatenate([o[:m] for o, m in zip(order, most)])
                # the nearest lists that hold k + 1 vectors
                first = np.concatenate([np.concatenate([[0], h[: m - 1]]) < k + 1 for h, m in zip(held, most)])
                yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(of)), pa.array(to, pa.int32()), pa.array(first)], ["key", "list", "first"])

    questions = stored(asked.dropDuplicates(["key"]).select("key", "v"), "questions")
    probed = stored(questions.mapInArrow(to_probes, "key string, list int, first boolean"), "probes")
    asking = np.zeros(lists + 1, dtype=np.int64)
    for r in probed.groupBy("list").count().collect():  # at most MOST_LISTS rows
        asking[r["list"]] = r["count"]
    query_blocks = np.maximum(1, -(-asking // BLOCK))
    plan = spark.createDataFrame([(i, int(row_blocks[i]), int(query_blocks[i])) for i in range(lists + 1)], "list int, n_rows int, n_queries int")
    plan = F.broadcast(plan)  # at most MOST_LISTS rows

    def blocks(df: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        placed = df.join(plan, "list").withColumn(own_name, F.pmod(F.xxhash64("key"), F.col(own)).cast("int"))
        return placed.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("n_rows", "n_queries")

    left = blocks(listed, "n_rows", "n_queries", "row_block", "query_block")
    cell = ["list", "row_block", "query_block"]

    def scan(key, asked_here, candidates):
        if not candidates.num_rows or not asked_here.num_rows:
            return pa.table({"query": pa.array([], pa.string()), "key": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        own, seeking = _matrix(candidates["v"], dims), _matrix(asked_here["v"], dims)
        if key[0].as_py() == lists:
            best = best_exact(seeking, own, k + 1)
        else:
            turned = lengthened(own, longest) @ turn
            units = unit(seeking)
            turned_queries = np.hstack([units, np.zeros((len(units), 1))]) @ turn
            # the score of the bound as a distance between lengthened vectors
            scores_found = asked_here["bound"].to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.abs(seeking).max(axis=1)
            size = size * np.sqrt(((seeking / size[:, None]) ** 2).sum(axis=1))
            bounds = 1 + longest**2 - 2 * scores_found / size
            # a bound beyond doubles is that of an outsize vector: nothing here is above it
            bounds = np.where(np.isnan(bounds), np.where(np.isposinf(scores_found), -np.inf, np.inf), bounds)
            near_ones = adaptive_scan(turned_queries, turned, k + 1, bounds)
            best = ((number, places, (own[places] * seeking[number]).sum(axis=1)) for number, places in near_ones)
        of, at, scores = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
        for number, places, found in best:
            of.append(np.full(len(places), number))
            at.append(places)
            scores.append(found)
        of, at = np.concatenate(of), np.concatenate(at)
        keys = [asked_here["key"].combine_chunks().take(pa.array(of)), candidates["key"].combine_chunks().take(pa.array(at))]
        return pa.table({"query": keys[0], "key": keys[1], "score": np.concatenate(scores)})

    def scanned(part: DataFrame) -> DataFrame:
        right = blocks(part.join(questions, "key"), "n_queries", "n_rows", "query_block", "row_block")
        return right.groupBy(*cell).cogroup(left.groupBy(*cell)).applyInArrow(scan, "query string, key string, score double")

    # k + 1 distinct vectors hold the k nearest ids; ties at the end are kept
    closest = Window.partitionBy("query").orderBy(F.desc("score"))

    def best_of(df: DataFrame) -> DataFrame:
        return df.withColumn("at", F.rank().over(closest)).filter(F.col("at") <= k + 1).select("query", "key", "score")

    # the nearest lists give every query a bound, so that the others return only what is better
    near = stored(best_of(scanned(probed.filter("first").withColumn("bound", F.lit(None).cast("double")))), "near")
    bounds = near.groupBy(F.col("query").alias("key")).agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("bound"))
    far = scanned(probed.filter("not first").join(bounds, "key", "left"))
    closest_vectors = stored(best_of(near.unionByName(far)), "found")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    per_vector = closest_vectors.join(members, "key").withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    per_vector = stored(per_vector.select(F.col("query").alias("key"), F.col("id").alias("other"), "score"), "nearest")
    answered = asked.select("id", "key").join(per_vector, "key").filter("id <> other")
    own_rank = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.desc("score"), "other"))
    ranked = answered.withColumn("rank", own_rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("id").cast(kind).alias("query_id"), "rank", F.col("other").cast(kind).alias(id_col), "score")


def nearest_by_brute_force(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, k: int = 20) -> dict[int, list[tuple[int, float]]]:
    """(id, score) of the k largest inner products of each query, in plain numpy; for tests."""
    out = {}
    for query in query_ids:
        scores = (vectors * vectors[ids == query][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:k]
        out[int(query)] = [(int(ids[i]), float(scores[i])) for i in order]
    return out
