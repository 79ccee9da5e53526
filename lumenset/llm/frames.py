"""Row keys, packed texts, ranks and stored steps that the operators share."""

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.kinds import quoted
from ..session import scratch_path

BATCH_ROWS = 500
BATCH_BYTES = 16 << 20
ROWS_PER_FILE = 200_000


def bound_batches(spark: SparkSession) -> None:
    """Long texts make large Arrow batches; hold them to a few megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them again: cuts lineage, survives lost executors.

    Where the caller knows that there are ``rows`` at most, they go to as few files as that needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(rows // ROWS_PER_FILE + 1)
    # this codec needs no buffers outside the heap, which many small files would fill
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_text`` and the other columns as one struct ``_rest``, so that no name can clash."""
    rest = [quoted(c) for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(
        quoted(id_col).cast("long").alias("_id"),
        quoted(text_col).cast("string").alias("_text"),
        (F.struct(*rest) if rest else F.lit(None).cast("struct<none:int>")).alias("_rest"),
    )


def unpacked(df: DataFrame, docs: DataFrame, id_col: str, text: Column | None, text_col: str, more: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` in their order, with the text given; columns in ``more`` replace equal names."""
    kinds = dict(docs.dtypes)
    columns = []
    for name in docs.columns:
        if name in more:
            continue
        if name == id_col:
            columns.append(F.col("_id").cast(kinds[name]).alias(name))
        elif name == text_col:
            columns.append((F.col("_text") if text is None else text).alias(name))
        else:
            columns.append(F.col("_rest").getField(name).alias(name))
    return df.select(*columns, *[c.alias(n) for n, c in more.items()])


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def packed(rows: DataFrame, row_key=None) -> DataFrame:
    """The rows with ``_text`` replaced by ``_blob``, the compressed bytes (null stays null), for shuffles of whole texts.

    ``row_key(ids, texts)`` adds its keys, byte strings, as ``_row``.
    """
    schema = T.StructType([f for f in rows.schema if f.name != "_text"] + [T.StructField("_blob", T.BinaryType())])
    keep = [f.name for f in rows.schema if f.name != "_text"]
    if row_key:
        schema = schema.add("_row", T.BinaryType())

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = binary(batch["_text"])
            columns = [*[batch[k] for k in keep], pa.array([None if t is None else press.compress(t) for t in texts], pa.binary())]
            if row_key:
                columns.append(row_key(batch["_id"].to_pylist(), [t or b"" for t in texts]))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(pack, schema)


def opened(blobs: pa.Array) -> list[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return [None if b is None else press.decompress(b, max_output_size=0) for b in blobs.to_pylist()]


def with_rank(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Stored rows with their place (from 0) in the total order of ``order``, and how many rows there are.

    Rows are range-partitioned and sorted; a row's place is its number within the partition plus the
    sizes of the partitions before. Only one count per partition comes to the driver.
    """
    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    numbered = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["count"] for r in numbered.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    starts = spark.createDataFrame(before, "_part long, _before long")
    ranked = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return ranked.withColumn("_rank", place).drop("_part", "_before", "_at"), total


def rank_within(df: DataFrame, group: str, order: list[str], buckets: DataFrame) -> DataFrame:
    """Add ``_rank`` (from 0) within ``group``, where one group may hold most rows.

    A group is cut into hash buckets, as many as ``buckets`` (``_group``, ``_many``; small enough to be broadcast) says; a row's rank is
    its number in the bucket plus the counts of the buckets before.
    """
    counted = df.join(F.broadcast(buckets), F.col(group) == F.col("_group"))
    bucketed = counted.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_many"))).drop("_group", "_many")
    counts = bucketed.groupBy(group, "_bucket").count()
    ahead = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_of"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    rows = bucketed.withColumn("_in", within)
    joined = rows.join(starts, (F.col(group) == F.col("_of")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_rank", F.col("_before") + F.col("_in")).drop("_bucket", "_of", "_b", "_before", "_in")
