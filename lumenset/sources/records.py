"""Records of CSV files whose quoted values may hold line breaks, cut by many tasks per file.

A file is read by blocks, line by line. Whether a line begins inside a quoted value depends on all lines before it, but only
through one bit, so every line is a map of that bit to the bit at its end: most leave it as it is, some swap it, some end in one
state whatever they began in. The task that reads a block composes the maps of its lines as they come, the maps of the blocks before
give the bit with which a block begins, and the task that reads the block again cuts its records, a batch of lines at a time. Only
lines of records that go on over the edge of a block are shuffled.
"""

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.joins import BROADCAST_BYTES
from ..session import cut_lineage

OPEN_END = "a quoted value is never closed"
MOVED = "the blocks of a file were cut anew while it was read"
UNORDERED = "the lines of a block do not come in their order"
# Bytes of a row about a block besides the file's path.
BLOCK_BYTES = 64

# workers get the functions themselves: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# After a quote: inside a value (1), or behind one that the quote closed (2); elsewhere a quote opens a value (3) or is a plain character (0).
PLAIN, INSIDE, CLOSED, READY = 0, 1, 2, 3


def ends_inside(line: Column, inside: bool) -> Column:
    """Whether a quoted value is open at the end of a line, if one was or was not at its start.

    A quote opens a value at the start of a field only; inside a value two quotes stand for one; a quote behind the text that
    follows a closed value is a plain character.
    """
    pieces = F.split(line, '"', -1)
    after = lambda piece, otherwise: F.when(F.endswith(piece, F.lit(",")), READY).otherwise(otherwise)
    first = F.lit(INSIDE) if inside else F.when(pieces[0] == "", READY).otherwise(after(pieces[0], F.lit(PLAIN)))

    def step(state, piece):
        opened = state.isin(READY, CLOSED)
        closed = F.when(piece == "", CLOSED).otherwise(after(piece, F.lit(PLAIN)))
        return F.when(opened, INSIDE).when(state == INSIDE, closed).otherwise(after(piece, F.lit(PLAIN)))

    rest = F.slice(pieces, F.lit(2), F.size(pieces))
    return F.when(F.contains(line, F.lit('"')), F.aggregate(rest, first, step) == INSIDE).otherwise(F.lit(inside)).cast("int")


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, id, line): lines end in a line feed, ids grow within a block, ``block`` is where it starts in the file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return lines.select(*where, F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))


def line_breaks(lines: DataFrame) -> tuple[bool, bool, bool]:
    """Whether a quoted value goes on over a line feed, whether a carriage return stands inside a line, and whether a file has several blocks."""
    returns = F.instr("line", "\r").between(1, F.length("line") - 1)
    row = lines.agg(F.max(returns), F.max("block")).first()
    # the first line found is enough
    breaks = not lines.filter(ends_inside(F.col("line"), False) == 1).isEmpty()
    return breaks, bool(row[0]), bool(row[1])


def _end(line: bytes, inside: int) -> int:
    """:func:`ends_inside` for one line."""
    first, *rest = line.split(b'"')
    state = INSIDE if inside else READY if not first or first.endswith(b",") else PLAIN
    for piece in rest:
        if state in (READY, CLOSED):
            state = INSIDE
        elif state == INSIDE and not piece:
            state = CLOSED
        else:
            state = READY if piece.endswith(b",") else PLAIN
    return int(state == INSIDE)


MAPS = "number long, end0 int, end1 int, head1 long, tail0 long, tail1 long"


def _block_maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does to the state it begins in (0 or 1), from its lines with quotes (number of the block, id, line): the state at its end,
    and with it the id of the line that ends the record it begins in (head) and of the line that begins the record open at its end (tail)."""
    of, last = None, -1
    end0, end1, head1, tail0, tail1 = 0, 1, None, None, None
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((of, end0, end1, head1, tail0, tail1), kinds)], ["number", "end0", "end1", "head1", "tail0", "tail1"])

    for batch in batches:
        for number, id_, line in zip(*(c.to_pylist() for c in batch.columns)):
            if number != of:
                if of is not None:
                    yield row()
                of, last = number, -1
                end0, end1, head1, tail0, tail1 = 0, 1, None, None, None
            if id_ <= last:
                raise ValueError(UNORDERED)
            last = id_
            after0 = _end(line, end0)
            after1 = after0 if end0 == end1 else _end(line, end1)
            if after0 != end0:
                tail0 = id_ if after0 else None
            if after1 != end1:
                if not after1 and head1 is None and tail1 is None:
                    head1 = id_
                tail1 = id_ if after1 else None
            end0, end1 = after0, after1
    if of is not None:
        yield row()


def _cut_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, id, record, first) of the lines of blocks that begin and end outside of a record; ``first`` is the first record of its block that is
    not blank."""
    open_, of, begun = [], None, False
    for batch in batches:
        numbers, ids, records, firsts = [], [], [], []
        for number, id_, line in zip(*(c.to_pylist() for c in batch.columns)):
            if number != of:
                of, begun = number, False
            if not open_:
                start = id_
            if b'"' in line:
                inside = _end(line, int(bool(open_)))
            else:
                inside = bool(open_)
            if inside:
                open_.append(line)
                continue
            if open_:
                line = b"\n".join([*open_, line])
                open_ = []
            line = line.removesuffix(b"\r")
            if not line.strip(b" "):
                continue
            numbers.append(number)
            ids.append(start)
            records.append(line)
            firsts.append(not begun)
            begun = True
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, pa.int64()), pa.array(records, pa.binary()), pa.array(firsts, pa.bool_())], ["number", "id", "record", "first"])


def _composed(window, place: str, start: Column) -> Column:
    """The state after the rows of a window, ordered by ``place``: what the last settling one leaves, swapped as often as rows behind it do.

    ``turned`` counts the swaps up to and including a row.
    """
    last = F.max(F.when(F.col("settles").isNotNull(), F.struct(place, "settles", "turned"))).over(window)
    turned = F.coalesce(F.max("turned").over(window), F.lit(0))
    return F.pmod(F.coalesce(last["settles"] - last["turned"], start) + turned, F.lit(2))


def _known(blocks: DataFrame) -> tuple[DataFrame, bool]:
    """A table of a row per block for a join with lines, and whether it is small enough to be broadcast, so that lines stay in their order."""
    n, width = blocks.agg(F.count(F.lit(1)), F.max(F.octet_length("file"))).first()
    small = n * ((width or 0) + BLOCK_BYTES) <= BROADCAST_BYTES
    return F.broadcast(blocks) if small else blocks, small


def block_starts(lines: DataFrame, in_order: bool = False) -> DataFrame:
    """(file, block, number, start, end, head, tail, carried): the states in which each block begins and ends, the id of the line up to which it
    goes on with the record it begins in, of the line that begins the record open at its end, and of that at the end of the blocks before.
    One row per block, with a number of its own.

    Lines ``in_order``, as files are read, stay in their tasks; others are first brought to a task per block.
    """
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = cut_lineage(blocks.select("file", "block", F.monotonically_increasing_id().alias("number")))
    known, small = _known(blocks)
    # lines that change nothing are left out, and text may be no valid UTF-8
    acts = lines.filter(F.contains("line", F.lit('"'))).join(known, ["file", "block"]).select("number", "id", F.col("line").cast("binary").alias("line"))
    if not (in_order and small):
        acts = acts.repartition("number").sortWithinPartitions("number", "id")
    maps = acts.mapInArrow(_block_maps, MAPS)
    whole = blocks.join(maps, "number", "left").withColumns({"end0": F.coalesce("end0", F.lit(0)), "end1": F.coalesce("end1", F.lit(1))})
    settles = F.when(F.col("end0") == F.col("end1"), F.col("end0"))
    whole = whole.withColumns({"settles": settles, "swaps": (F.col("end0") > F.col("end1")).cast("int")})
    upto = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.withColumn("turned", F.sum("swaps").over(upto)).withColumn("start", _composed(before, "block", F.lit(0)))
    begun = lambda one, none: F.when(F.col("start") == 1, one).otherwise(none)
    whole = whole.withColumns({"end": begun(F.col("end1"), F.col("end0")), "head": begun(F.col("head1"), F.lit(None)), "tail": begun(F.col("tail1"), F.col("tail0"))})
    carried = F.last("tail", ignorenulls=True).over(before)
    return cut_lineage(whole.select("file", "block", "number", "start", "end", "head", "tail", carried.alias("carried")))


def read_records(lines: DataFrame) -> DataFrame:
    """(file, block, id, record, first) of lines as :func:`file_lines` gives them; a record over several lines has the id and block of the first,
    ``first`` is the first of a block that is not blank.

    A value that is never closed is an error. Carriage returns before line feeds inside values stay, the one at the end of a record goes.
    """
    starts = block_starts(lines, in_order=True)
    behind = W.partitionBy("file").orderBy(F.desc("block"))
    open_ = starts.withColumn("place", F.row_number().over(behind)).filter("place = 1 and end = 1").select("file").head(1)
    if open_:
        raise ValueError(f"{OPEN_END}: {open_[0]['file']}")
    known, small = _known(starts)
    placed = lines.join(known, ["file", "block"], "left")
    # a cluster that grows may cut files anew between two scans
    placed = placed.filter(F.when(F.col("start").isNull(), F.raise_error(F.lit(MOVED)).cast("boolean")).otherwise(True))
    heads = (F.col("start") == 1) & (F.col("head").isNull() | (F.col("id") <= F.col("head")))
    placed = placed.withColumn("of", F.when(heads, F.col("carried")).when(F.col("id") >= F.col("tail"), F.col("tail")))

    inner = placed.filter("of is null").select("number", "id", F.col("line").cast("binary").alias("line"))
    if not small:  # the join has changed their order
        inner = inner.repartition("number").sortWithinPartitions("number", "id")
    cut = inner.mapInArrow(_cut_records, "number long, id long, record binary, first boolean")
    cut = cut.join(known.select("number", "file", "block"), "number")
    cut = cut.select("file", "block", "id", F.col("record").cast("string").alias("record"), "first")

    listed = F.sort_array(F.collect_list(F.struct("block", "id", "line")))
    joined = placed.filter("of is not null").groupBy("file", "of").agg(listed.alias("lines"))
    record = F.array_join(F.col("lines")["line"], "\n")
    end = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    joined = joined.select("file", F.col("lines")[0]["block"].alias("block"), F.col("of").alias("id"), record.alias("record"), F.lit(False).alias("first"))
    return cut.unionByName(joined.withColumn("record", end).filter(F.length(F.trim("record")) > 0))
