"""Best-fit packing planned on the histogram of lengths.

Only the number of pieces of each length reaches the driver, at most one count per length. Best-fit
decreasing runs on those counts and moves whole groups of equal sequences at a time, so the plan is bounded by
the sequence length, not by the corpus. A piece then finds its place by its rank among the pieces of its length.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import binary, bound_batches, rank_within, stored, text_rows
from .tokens import default_path, token_ids

ROWS_PER_BUCKET = 4_096
PIECES = "doc long, piece int, start long, length long, ids_crc32 long"


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns runs (length, first rank, pieces, pieces per sequence, first sequence, offset): of the pieces of that
    length from that rank on, every ``pieces per sequence`` in a row go to one sequence, one sequence after the other.
    """
    free = {}  # room left -> groups (first sequence, number of sequences)
    runs, sequences = [], 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                room, whole = capacity, capacity // length
                free[room] = [(sequences, -(-left // whole))]
                sequences += -(-left // whole)
            first, many = free[room].pop()
            if not free[room]:
                del free[room]
            each = room // length
            full = min(many, left // each)
            for bins, per in ((full, each), (1 if full < many and 0 < left - full * each else 0, left - full * each)):
                if not bins:
                    continue
                runs.append((length, rank, bins * per, per, first, capacity - room))
                rank, left = rank + bins * per, left - bins * per
                if room - per * length:
                    free.setdefault(room - per * length, []).append((first, bins))
                first, many = first + bins, many - bins
            if many:
                free.setdefault(room, []).append((first, many))
    return runs


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first piece may be shorter than the others."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, path: str) -> DataFrame:
    """One row per piece of every document: ids of the text, then ``end_id``, cut where longer than ``capacity``."""
    bound_batches(docs.sparkSession)
    rows = text_rows(docs.select(id_col, text_col), id_col, text_col).select("_id", "_text")

    def encode(batches):
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch["_id"].to_pylist(), binary(batch["_text"])):
                ids = np.append(token_ids(text, path), np.uint32(end_id)).astype("<u4")
                for number, (begin, many) in enumerate(cut(len(ids), capacity)):
                    of.append(doc)
                    piece.append(number)
                    start.append(begin)
                    length.append(many)
                    crc.append(zlib.crc32(ids[begin : begin + many].tobytes()))
            columns = [pa.array(of, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(encode, PIECES)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None
) -> DataFrame:
    """One row per piece: its id under its own name, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.

    A document is the ids of its text and ``end_id`` after them. Only longer ones than ``capacity`` are cut, into pieces of
    ``capacity`` ids of which the first may be shorter. Sequences hold at most ``capacity`` ids and have no gaps.

    A null or empty text is ``end_id`` alone. Rows without an id and repeated rows are packed like others. Of pieces
    of one length the smaller id is placed first; equal rows are interchangeable. An empty table gives none.
    """
    pieces = stored(token_pieces(docs, id_col, text_col, capacity, end_id, path or default_path()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = sorted(best_fit(counts, capacity))
    plan = {c: np.array([r[i] for r in runs], dtype=np.int64) for i, c in enumerate(("length", "rank", "n", "per", "first", "offset"))}
    # one row per length
    buckets = docs.sparkSession.createDataFrame([(n, many // ROWS_PER_BUCKET + 1) for n, many in counts.items()], "_group long, _many long")
    ranked = rank_within(pieces, "length", ["doc", "piece", "start", "ids_crc32"], buckets)

    def place(batches):
        keys = plan["length"] << 40 | plan["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            within = rank - plan["rank"][at]
            sequence = plan["first"][at] + within // np.maximum(plan["per"][at], 1)
            offset = plan["offset"][at] + within % np.maximum(plan["per"][at], 1) * length
            kept = [batch[c] for c in ("doc", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    placed = ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
    kind = docs.schema[id_col].dataType
    return placed.select(F.col("doc").cast(kind).alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequence_ids(docs: DataFrame, packing: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and ``ids``, in the order of their offsets.

    ``packing`` is what :func:`pack_documents` made of ``docs``. Rows that repeat an id must repeat its text (null is an id like others); an id
    of several texts is an error, as a piece does not tell which of them it is from. Without rows there are no sequences.
    """
    path = path or default_path()
    wanted = packing.groupBy(F.col(id_col).alias("_of")).agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("_pieces"))
    rows = text_rows(docs.select(id_col, text_col), id_col, text_col)
    rows = rows.withColumn("_digest", F.sha2(F.coalesce("_text", F.lit("")), 256))
    several = rows.groupBy("_id").agg(F.min("_digest").alias("least"), F.max("_digest").alias("most")).filter("least <> most")
    if not several.isEmpty():
        raise ValueError("an id has several texts: packed pieces can't be told apart")
    joined = rows.dropDuplicates(["_id"]).join(wanted, F.col("_id").eqNullSafe(F.col("_of"))).select("_text", "_pieces")

    def encode(batches):
        for batch in batches:
            out = []
            for text, pieces in zip(binary(batch["_text"]), batch["_pieces"].to_pylist()):
                ids = np.append(token_ids(text, path), np.uint32(end_id))
                out += [(p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]].tolist()) for p in pieces]
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["sequence_id", "offset", "ids"])

    parts = joined.mapInArrow(encode, "sequence_id long, offset long, ids array<int>")
    whole = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
