"""Sharding along a Hilbert curve over several metadata columns.

Every dimension is quantised, the curve index of the resulting cell orders the rows, and the order is cut into
runs of equal row counts. Neighbours on the curve agree in all dimensions at once, so a filter on any of them
meets few shards and, within a shard, few row groups.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.kinds import quoted
from .frames import stored, with_rank

BITS = 10


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates (below 2**bits), by the transposed form of the index."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = (x[:, 0] ^ x[:, i]) & (q - 1)
            x[:, 0] ^= np.where(high, q - 1, swap)
            x[:, i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    index = np.zeros(len(x), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[:, i] >> bit & 1)
    return index


def _category_codes(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: the place of a value among the distinct ones, spread over the cells; null is the first."""
    values = rows.select(F.col(column).alias("_value")).distinct()
    ranked, many = with_rank(values, ["_value"], "values")
    code = F.floor(F.col("_rank") * F.lit((1 << BITS) / max(many, 1))).cast("int")
    return rows.join(ranked.select("_value", code.alias(name)), F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def hilbert_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), shards: int = 8
) -> DataFrame:
    """One row per row of ``docs``: its id under its own name, ``size``, ``text_crc32``, ``curve``, ``shard`` and ``slot``.

    Size: UTF-8 bytes of the text plus 1. Dimensions: the category columns by the order of their values, and the
    size on a logarithmic scale. Rows are sorted by the curve, then id, checksum and size, and cut into ``shards`` runs whose
    counts differ by one at most; ``slot`` counts from 0 in each. With fewer rows than shards some shards are empty.

    A null text is empty: size 1, checksum 0. A null category is a value of its own. Rows without an id come first in their
    cell; equal rows are interchangeable. An empty table gives none.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary")
    named = [f"_c{i}" for i in range(len(categories))]
    rows = docs.select(
        quoted(id_col).cast("long").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), *[quoted(c).cast("string").alias(n) for c, n in zip(categories, named)],
    )
    rows = stored(rows, "facts")
    lo, hi = rows.agg(F.min(F.log2("size")), F.max(F.log2("size"))).first()
    for name in named:
        rows = _category_codes(rows, name, f"{name}_code")
    step = ((1 << BITS) - 1) / (hi - lo) if hi is not None and hi > lo else 0.0
    rows = rows.withColumn("_size_code", F.floor((F.log2("size") - F.lit(lo or 0.0)) * F.lit(step)).cast("int"))
    codes = [*[f"{n}_code" for n in named], "_size_code"]

    def index(batches):
        for batch in batches:
            cells = np.stack([batch[c].to_numpy() for c in codes], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], batch["size"], batch["text_crc32"], pa.array(curve_index(cells, BITS), pa.int64())],
                ["_id", "size", "text_crc32", "curve"],
            )

    placed = rows.select("_id", "size", "text_crc32", *codes).mapInArrow(index, "_id long, size long, text_crc32 long, curve long")
    ranked, total = with_rank(placed, ["curve", "_id", "text_crc32", "size"], "curve")
    rows_in_all = max(total, 1)
    shard = f"(_rank * {shards}) div {rows_in_all}"
    first = f"(({shard}) * {rows_in_all} + {shards - 1}) div {shards}"
    kind = docs.schema[id_col].dataType
    return ranked.select(
        F.col("_id").cast(kind).alias(id_col), "size", "text_crc32", "curve", F.expr(shard).cast("int").alias("shard"), F.expr(f"_rank - {first}").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the rows of ``docs`` under one folder per shard, sorted by ``slot``, as Parquet; returns the placement.

    Folders are named by ``_shard`` and rows have their ``_slot``, with further underscores before it if ``docs`` has such a column. Ids must be distinct, null
    being one; a repeated id is an error, as a row could not be told its place. An empty table writes no folder.
    """
    if not docs.groupBy(quoted(id_col)).count().filter("count > 1").isEmpty():
        raise ValueError("ids must be distinct")
    taken = [c.lower() for c in docs.columns]
    folder, place = "_shard", "_slot"
    while folder in taken:
        folder = "_" + folder
    while place in taken:
        place = "_" + place
    placement = stored(hilbert_shards(docs, id_col, text_col, **options), "placement")
    keyed = placement.select(quoted(id_col).alias("of"), F.col("shard"), F.col("slot"))
    whole = docs.select(quoted(id_col).alias("id"), F.struct(*[quoted(c) for c in docs.columns]).alias("row"))
    joined = whole.join(keyed, F.col("id").eqNullSafe(F.col("of")))
    # several tasks share a shard: each writes a run of slots
    parts = joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    named = parts.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("slot").alias(place), F.col("shard").alias(folder))
    named.write.partitionBy(folder).parquet(path)
    return placement

