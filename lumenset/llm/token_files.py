"""Training-order token files: a keyed permutation gives every sequence its slot, shards hold fixed-stride records.

A sequence is known by (document id, piece). A Feistel network permutes the numbers of all possible pairs, and
cycle-walking keeps it inside their exact range; so the order depends on the key alone, needs no state, and
any task can compute the place of any sequence. Ranges of permuted numbers are the shards. Within a
shard the records stand in permuted order; the counts of the shards before turn a position into the global slot.

A record is ``HEADER`` bytes (document id, piece, number of ids), then ``length`` ids, the last of which
is always the end id 0. Record i of a shard starts at byte i * stride, so a reader can resume anywhere.
"""

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .frames import binary, bound_batches, text_rows
from .tokens import default_path, token_ids

LENGTH = 512
SHARD_BYTES = 32 << 20
ROUNDS = 6
KEY = 20260107
HEADER = 16
NO_ID = -(1 << 63)
# written after every record by Spark's text sink: the two zero bytes of the last id
END = "\x00\x00"


def permuted(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size), computed for ``numbers`` (64-bit, below size, size below 2**62)."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng(key).integers(1, 1 << 62, ROUNDS, dtype=np.uint64)

    def network(x):
        left, right = x >> half, x & mask
        for k in keys:
            y = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((y ^ (y >> np.uint64(32))) & mask)
        return left << half | right

    out = network(numbers.astype(np.uint64))
    while True:
        outside = np.flatnonzero(out >= np.uint64(size))
        if not len(outside):
            return out.view(np.int64)
        out[outside] = network(out[outside])


def write_token_shards(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, key: int = KEY,
    shard_bytes: int = SHARD_BYTES, tokenizer: str | None = None,
) -> int:
    """Write the sequences of all documents under ``path``, one folder with one file per shard; returns the number of shards.

    A document is the ids of its text and the end id 0, cut into pieces of ``length - 1`` ids. Shorter
    pieces are filled with 0. Ids take two bytes, little-endian; the vocabulary must be below 65,536.

    A null or empty text is the end id alone. Rows without an id come where the number after the largest would. Rows of
    one id stand next to each other. An empty table writes nothing. Ids must span less than 2**62 / (pieces of the longest text).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer = tokenizer or default_path()
    room = length - 1
    rows = text_rows(docs.select(id_col, text_col), id_col, text_col).select("_id", "_text")
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    n, least, most, longest, total = rows.agg(F.count(F.lit(1)), F.min("_id"), F.max("_id"), F.max(size), F.sum(size)).first()
    if not n:
        return 0
    least, most = least or 0, most or 0
    # a text has no more ids than bytes
    pieces = -(-(longest + 1) // room)
    numbers = (most - least + 2) * pieces
    if numbers >= 1 << 62:
        raise ValueError("document ids are too far apart to number their pieces in 62 bits")
    stride = HEADER + 2 * length
    n_shards = max(1, -(-(n * stride // 2 + total * 2 // 3) // shard_bytes))
    width = -(-numbers // n_shards)

    def encode(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            of, piece, records = [], [], []
            for doc, text in zip(batch["_id"].to_pylist(), binary(batch["_text"])):
                ids = np.append(token_ids(text, tokenizer), np.uint32(0)).astype("<u2")
                for number in range(-(-len(ids) // room)):
                    part = ids[number * room : (number + 1) * room]
                    header = np.array([NO_ID if doc is None else doc, number << 32 | len(part)], dtype="<i8").tobytes()
                    of.append(most - least + 1 if doc is None else doc - least)
                    piece.append(number)
                    records.append(press.compress(header + part.tobytes() + bytes(2 * (room - len(part)))))
            at = permuted(np.array(of, dtype=np.int64) * pieces + np.array(piece, dtype=np.int64), numbers, key)
            yield pa.RecordBatch.from_arrays([pa.array(at // width, pa.int32()), pa.array(at), pa.array(records, pa.binary())], ["shard", "at", "record"])

    def unpack(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = [press.decompress(r) for r in batch["record"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["shard"], pa.array(raw, pa.binary())], ["shard", "record"])

    encoded = rows.mapInArrow(encode, "shard int, at long, record binary")
    laid = encoded.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "at", "record")
    # the bytes pass through the text sink as they are; the order of records within a shard is that of the sort
    raw = laid.select("shard", "record").mapInArrow(unpack, "shard int, record binary")
    raw.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", END).text(path)
    return n_shards


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.withColumn("shard", F.col("shard").cast("int"))


def manifest(spark: SparkSession, path: str, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(shard, first slot, records) of every file, from their lengths alone; one row per shard."""
    stride = HEADER + 2 * length
    rows = _files(spark, path).select("shard", "length").collect()
    out, before = [], 0
    for row in sorted(rows):
        if row["length"] % stride:
            raise ValueError(f"shard {row['shard']} is not a whole number of records")
        out.append((row["shard"], before, row["length"] // stride))
        before += row["length"] // stride
    return out


def read_sequences(spark: SparkSession, path: str, length: int = LENGTH, first_slot: int = 0, n: int | None = None) -> DataFrame:
    """``slot``, ``shard``, ``byte_offset``, ``doc``, ``piece``, ``n_ids`` and ``ids`` (bytes) of the records from a slot on.

    Only shards that hold wanted slots are read.
    """
    stride = HEADER + 2 * length
    last = None if n is None else first_slot + n
    starts = {shard: before for shard, before, many in manifest(spark, path, length) if before + many > first_slot and (last is None or before < last)}
    bound_batches(spark)
    files = _files(spark, path).select("shard", "content")
    if first_slot or last is not None:
        files = files.filter(F.col("shard").isin(list(starts)))

    def read(batches):
        for batch in batches:
            for shard, content in zip(batch["shard"].to_pylist(), batch["content"]):
                data = np.frombuffer(content.as_buffer(), dtype=np.uint8).reshape(-1, stride)
                for begin in range(0, len(data), 4096):
                    part = data[begin : begin + 4096]
                    slots = starts[shard] + np.arange(begin, begin + len(part))
                    wanted = (slots >= first_slot) & ((slots < last) if last is not None else True)
                    part, slots = part[wanted], slots[wanted]
                    heads = np.ascontiguousarray(part[:, :HEADER]).view("<i8").reshape(-1, 2)
                    sizes = heads[:, 1] & 0xFFFFFFFF
                    ids = [bytes(p[HEADER : HEADER + 2 * s]) for p, s in zip(part, sizes)]
                    columns = [
                        pa.array(slots, pa.int64()), pa.array(np.full(len(slots), shard), pa.int32()),
                        pa.array((slots - starts[shard]) * stride, pa.int64()), pa.array(heads[:, 0], pa.int64(), mask=heads[:, 0] == NO_ID),
                        pa.array(heads[:, 1] >> 32, pa.int32()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "byte_offset", "doc", "piece", "n_ids", "ids"])

    return files.mapInArrow(read, "slot long, shard int, byte_offset long, doc long, piece int, n_ids long, ids binary")


def token_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """Write the shards (to a new shared folder if no path is given) and return what they hold, read from the files:
    the id under its own name, ``piece``, ``slot``, ``shard``, ``byte_offset``, ``n_ids`` and ``ids_crc32`` (of the two-byte ids)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    kind = docs.schema[id_col].dataType
    if write_token_shards(docs, path, id_col, text_col, length, **options):
        found = read_sequences(spark, path, length)
    else:
        found = spark.createDataFrame([], "slot long, shard int, byte_offset long, doc long, piece int, n_ids long, ids binary")
    return found.select(
        F.col("doc").cast(kind).alias(id_col), "piece", "slot", "shard", "byte_offset", "n_ids", F.crc32("ids").alias("ids_crc32")
    )


def sequences_by_brute_force(docs: list[tuple], length: int, tokenizer: str | None = None) -> dict:
    """(id, piece) -> (number of ids, CRC-32 of their bytes) of (id, text) rows, in plain Python; for tests."""
    out = {}
    for doc, text in docs:
        ids = np.append(token_ids(text.encode() if text is not None else None, tokenizer or default_path()), 0).astype("<u2")
        for number, begin in enumerate(range(0, len(ids), length - 1)):
            part = ids[begin : begin + length - 1]
            out[doc, number] = (len(part), zlib.crc32(part.tobytes()))
    return out
