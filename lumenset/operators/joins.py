"""Joins that stay balanced when one key holds a large part of the rows."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.kinds import quoted
from ..session import cut_lineage

# Most bytes a table may have to be broadcast; callers measure or bound it before.
BROADCAST_BYTES = 64 * 1024 * 1024
# Rows of one key that one task may join; larger keys are spread over as many tasks as that needs.
SALT_ROWS = 1_000_000
# Bytes of a row besides its keys.
ROW_BYTES = 100
# Bytes of a bitmap, which tells of 32,768 ids whether they are in a list.
BITMAP_BYTES = 4096


@dataclass(frozen=True)
class GroupSizes:
    """Rows per group (``counted``: keys and ``_n``, stored), and totals over the groups."""

    counted: DataFrame
    n_groups: int
    largest: int
    n_rows: int
    key_bytes: int

    def stats_bytes(self, columns: int) -> int:
        """A bound on a table of one row per group with so many columns of fixed width."""
        return self.n_groups * (columns + 1) * ROW_BYTES + self.key_bytes


def group_sizes(df: DataFrame, keys: list[str]) -> GroupSizes:
    counted = cut_lineage(df.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("_n")))
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(quoted(k).cast("string")), F.lit(0)) for k in keys])
    row = counted.agg(F.count("*"), F.max("_n"), F.sum("_n"), F.sum(width.cast("long"))).first()
    return GroupSizes(counted, row[0], row[1] or 0, row[2] or 0, row[3] or 0)


def _match(keys: list[str], prefix: str):
    return reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(quoted(f"{prefix}{k}")) for k in keys])


def hot_groups(sizes: GroupSizes, keys: list[str], rows: int, broadcast_bytes: int) -> DataFrame:
    """Keys under a prefix and ``_pieces`` of the groups of more than ``rows`` rows. The limit rises where so many groups exceed it that
    their list could not be broadcast: there are at most all rows / limit of them."""
    row_bytes = ROW_BYTES + sizes.key_bytes // max(sizes.n_groups, 1)
    limit = max(rows, sizes.n_rows * row_bytes // max(broadcast_bytes, 1))
    hot = sizes.counted.where(F.col("_n") > limit).withColumn("_pieces", F.ceil(F.col("_n") / limit))
    return hot.drop("_n").withColumnsRenamed({k: f"_hot_{k}" for k in keys})


def stats_join(
    rows: DataFrame, stats: DataFrame, keys: list[str], spread: list, n_bytes: int, sizes: GroupSizes,
    broadcast_bytes: int | None = None, salt_rows: int | None = None,
) -> DataFrame:
    """Add the columns of ``stats`` (one row per key, ``n_bytes`` at most) to ``rows``.

    Small statistics are broadcast, so the rows stay where they are. Otherwise both sides are shuffled. Rows of a
    key with more than ``salt_rows`` are spread over as many shuffle keys as that needs, by a hash of ``spread``
    and of the task they come from, which is repeatable if a task is run again; only the statistics of
    such keys are repeated.
    """
    broadcast_bytes = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    renamed = stats.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    if n_bytes <= broadcast_bytes:
        joined = rows.join(F.broadcast(renamed), _match(keys, "_right_"), "left")
        return joined.drop(*[f"_right_{k}" for k in keys])
    hot = hot_groups(sizes, keys, SALT_ROWS if salt_rows is None else salt_rows, broadcast_bytes)
    gone = [f"_hot_{k}" for k in keys] + ["_pieces"]
    pieces = F.coalesce("_pieces", F.lit(1))
    salted = rows.join(F.broadcast(hot), _match(keys, "_hot_"), "left")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *spread), pieces)).drop(*gone)
    right = stats.join(F.broadcast(hot), _match(keys, "_hot_"), "left")
    right = right.withColumn("_right_salt", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop(*gone)
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    joined = salted.join(right, _match(keys, "_right_") & (F.col("_salt") == F.col("_right_salt")), "left")
    return joined.drop("_salt", "_right_salt", *[f"_right_{k}" for k in keys])


def same_group_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join two tables of one row per key, null equal to null."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return left.join(renamed, _match(keys, "_right_"), how).drop(*[f"_right_{k}" for k in keys])


def among(rows: DataFrame, column: str, ids: DataFrame, how: str = "left_semi", broadcast_bytes: int | None = None) -> DataFrame:
    """Rows whose ``column`` is among ``ids.id``, both bigint, or with ``left_anti`` the others; ids without a value match nothing. Ids are read twice.

    Ids that lie close together, as ids that count up do, are broadcast as bitmaps, so the rows stay where they are. If they lie too far apart for that, which
    is measured, both sides are shuffled.
    """
    broadcast_bytes = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    ids = ids.where("id is not null").select("id")
    if ids.agg(F.approx_count_distinct(F.bitmap_bucket_number("id"))).first()[0] * BITMAP_BYTES > broadcast_bytes:
        return rows.join(ids.withColumnRenamed("id", "_id"), F.col(column) == F.col("_id"), how)
    # each task makes bitmaps of the ids that it reads, and only these are dealt: ids that repeat are not gathered in one task
    maps = ids.groupBy(F.bitmap_bucket_number("id").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("_bits"))
    place = F.bitmap_bit_position(column)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), (F.bitmap_bucket_number(column) == F.col("_bucket")) & (F.getbit(byte, (place % 8).cast("int")) == 1), how)
