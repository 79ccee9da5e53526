"""Medians and quartiles of many columns per group, exact, whatever the size of a group.

The numbers of a group of at most ``group_rows`` rows meet in one aggregate. Larger groups keep their rows where they are: a
bounded sketch per group and column proposes two edges around every wanted rank, one pass counts the values between edges and
at them, and this repeats until few values lie between the edges around a rank. Only those are shuffled, as distinct values with
their counts. The edges and counts of all large groups are one stored table of a row per group, joined to the rows by a checked broadcast.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.kinds import number, quoted
from ..session import cut_lineage
from .joins import GroupSizes, hot_groups, same_group_join, stats_join
from .quantiles import SKETCH_ACCURACY

# Rows of a group whose numbers one task may hold, and values between two edges that one task may order.
GROUP_ROWS = 200_000
# Cells of the sketch's grid; edges lie a cell beyond the one that holds the rank, on either side.
GRID = 500
RANKS = ["m_low", "m_high", "q1_low", "q1_high", "q3_low", "q3_high"]
AMONG_FILLED = -1


def wanted_ranks(present: Column, gaps: Column) -> list[Column]:
    """The places (from 0, among present values in order) that median and quartiles need, as in :data:`RANKS`.

    Quartiles are those after every gap is filled with the median. Filled rows sit right behind the lower middle value;
    AMONG_FILLED marks a place among them.
    """
    middle = F.floor((present - 1) / 2)
    ranks = [middle, F.ceil((present - 1) / 2)]
    for p in (0.25, 0.75):
        at = (present + gaps - 1) * F.lit(p)
        for k in (F.floor(at), F.ceil(at)):
            ranks.append(F.when(k <= middle, k).when(k <= middle + gaps, F.lit(AMONG_FILLED)).otherwise(k - gaps))
    return [r.cast("bigint") for r in ranks]


def from_ranks(values: list[Column], present: Column, gaps: Column) -> Column:
    """A struct (median, q1, q3) from the values at :func:`wanted_ranks`, null where a place is among filled rows."""
    median = (values[0] + values[1]) / 2
    ends = []
    for i, p in ((2, 0.25), (4, 0.75)):
        at = (present + gaps - 1) * F.lit(p)
        weight = at - F.floor(at)
        low, high = (F.coalesce(v, median) for v in values[i : i + 2])
        ends.append((1 - weight) * low + weight * high)
    return F.when(present > 0, F.struct(median.alias("median"), ends[0].alias("q1"), ends[1].alias("q3")))


def group_quantiles(
    df: DataFrame, keys: list[str], columns: list[str], sizes: GroupSizes, limits: dict, group_rows: int = GROUP_ROWS, approx: bool = False
) -> DataFrame:
    """One row per group with a struct ``_<column>_stats`` (median, q1, q3): the median of the present values, quartiles after filling with it.

    ``limits`` are those of :func:`stats_join`. With ``approx`` all come from one sketch per group.
    """
    names = {c: f"v{i}" for i, c in enumerate(columns)}
    rows = df.select(*keys, *[number(df, c).alias(v) for c, v in names.items()])
    if approx:
        return _sketched(rows, keys, names)
    if sizes.largest <= group_rows:
        return _gathered(rows, keys, names)
    hot = hot_groups(sizes, keys, group_rows, limits["broadcast_bytes"])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    hidden = [f"_hot_{k}" for k in keys]
    marked = rows.join(F.broadcast(hot), same, "left").drop(*hidden)
    few = _gathered(marked.where("_pieces is null"), keys, names)
    large = marked.where("_pieces is not null").drop("_pieces")
    return few.unionByName(_bracketed(large, keys, names, sizes, limits, group_rows))


def _sketched(rows: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    grid = [i / GRID for i in range(GRID + 1)]
    sketches = [x for v in names.values() for x in (F.percentile_approx(v, grid, SKETCH_ACCURACY).alias(v), F.count(v).alias(f"{v}_n"))]
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *sketches)
    stats = []
    for c, v in names.items():
        present, gaps = F.col(f"{v}_n"), F.col("_rows") - F.col(f"{v}_n")
        cell = lambda r: F.round(r * F.lit(GRID) / F.greatest(present - 1, F.lit(1))).cast("int")  # noqa: E731, B023
        values = [F.get(F.col(v), F.when(r >= 0, cell(r))) for r in wanted_ranks(present, gaps)]
        stats.append(from_ranks(values, present, gaps).alias(f"_{c}_stats"))
    return found.select(*keys, *stats)


def _gathered(rows: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """Every group's numbers as one ordered array per column, from which all places are read at once.

    Rows go to their group's task before the arrays are made: arrays made before would be no smaller, and made twice.
    """
    listed = rows.select(*keys, F.struct(*names.values()).alias("_v")).repartition(*keys).groupBy(*keys).agg(F.collect_list("_v").alias("_rows"))

    def of(ordered: Column) -> Column:
        present = F.size(ordered).cast("bigint")
        gaps = F.size("_rows") - present
        return from_ranks([F.get(ordered, F.when(r >= 0, r).cast("int")) for r in wanted_ranks(present, gaps)], present, gaps)

    stats = []
    for c, v in names.items():
        ordered = F.sort_array(F.filter(F.col("_rows")[v], lambda x: x.isNotNull()))
        # a list of one list, so that it is put in order once and not for every place read
        stats.append(F.transform(F.array(ordered), of)[0].alias(f"_{c}_stats"))
    # written once: the arrays are read here and go no further
    return cut_lineage(listed.select(*keys, *stats))


def _bracketed(rows: DataFrame, keys: list[str], names: dict[str, str], sizes: GroupSizes, limits: dict, few: int) -> DataFrame:
    """The same for large groups. State per group and column ``v``: ``v_n`` present values, ``v_gaps``, and ``v_b``, per wanted rank a struct
    (rank, lo, hi, below, inside, value): the open interval around the rank, the values up to ``lo`` and inside it, and the value once it is known."""
    columns = list(names.values())
    counts = [x for v in columns for x in (F.count(v).alias(f"{v}_n"), (F.count(F.lit(1)) - F.count(v)).alias(f"{v}_gaps"))]
    state = cut_lineage(rows.groupBy(*keys).agg(*counts))
    state = state.withColumns({f"{v}_b": F.array(*[_whole(r, F.col(f"{v}_n")) for r in wanted_ranks(F.col(f"{v}_n"), F.col(f"{v}_gaps"))]) for v in columns})
    state_bytes = sizes.stats_bytes(len(columns) * (2 + 6 * len(RANKS)))

    def meet(table: DataFrame) -> DataFrame:
        joined = stats_join(rows, table.withColumn("_met", F.lit(True)), keys, columns, state_bytes, sizes, **limits)
        return joined.where("_met").drop("_met")

    first = True
    while first or not state.where(reduce(lambda a, b: a | b, [F.exists(f"{v}_b", lambda b: _open(b) & (b["inside"] > few)) for v in columns])).isEmpty():
        state = cut_lineage(_narrowed(meet, state, keys, columns, first, few))
        first = False
    return _picked(meet, state, keys, names)


def _whole(rank: Column, present: Column) -> Column:
    infinite = F.lit(float("inf"))
    fields = {"rank": rank, "lo": -infinite, "hi": infinite, "below": F.lit(0).cast("bigint"), "inside": present, "value": F.lit(None).cast("double")}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _open(b: Column) -> Column:
    """A rank whose value is wanted and not known yet."""
    return (b["rank"] >= 0) & b["value"].isNull() & (b["inside"] > 0)


def _between(v: Column, b: Column) -> Column:
    return ((v > b["lo"]) | (b["lo"] == float("-inf"))) & ((v < b["hi"]) | (b["hi"] == float("inf")))


def _narrowed(meet, state: DataFrame, keys: list[str], columns: list[str], first: bool, few: int) -> DataFrame:
    """The state after one more sketch and count. At first all ranks of a column share one sketch."""
    grid = [i / GRID for i in range(GRID + 1)]
    known = meet(state)
    sketches = {}
    for v in columns:
        for i in range(1 if first else len(RANKS)):
            b = F.col(f"{v}_b")[i]
            value = F.col(v) if first else F.when(_open(b) & (b["inside"] > few) & _between(F.col(v), b), F.col(v))
            sketches[v, i] = F.percentile_approx(value, grid, SKETCH_ACCURACY).alias(f"{v}_s{i}")
    sketched = cut_lineage(known.groupBy(*keys).agg(*sketches.values()))
    both = same_group_join(state, sketched, keys)
    edges = {}
    for v in columns:
        ends = []
        for i in range(len(RANKS)):
            b, sketch = F.col(f"{v}_b")[i], F.col(f"{v}_s{0 if first else i}")
            cell = F.floor((b["rank"] - b["below"]) * F.lit(GRID) / b["inside"])
            use = _open(b) & (b["inside"] > few) if not first else _open(b)
            ends += [F.when(use, F.get(sketch, F.greatest(cell - 1, F.lit(0)).cast("int"))), F.when(use, F.get(sketch, F.least(cell + 2, F.lit(GRID)).cast("int")))]
        edges[f"{v}_e"] = F.array_sort(F.array_distinct(F.array_compact(F.array(*ends))))
    with_edges = cut_lineage(both.withColumns(edges).drop(*[f"{v}_s{i}" for v, i in sketches]))
    # where a value lies: 2 k between the edges k - 1 and k, 2 k + 1 at edge k. A row per value comes first: one expression over the values of all
    # columns is too long to be compiled
    ends = range(2 * len(RANKS))
    around = with_edges.select(*keys, *[F.struct(*[F.get(F.col(f"{v}_e"), F.lit(j)).alias(f"_{j}") for j in ends]).alias(f"{v}_s") for v in columns])
    cells = [F.struct(F.lit(i).alias("_c"), F.col(v).alias("_v"), F.col(f"{v}_s").alias("_s")) for i, v in enumerate(columns)]
    values = meet(around).select(*keys, F.inline(F.array(*cells))).where("_v is not null")
    slot = reduce(lambda a, b: a + b, [F.when(F.col(f"_s._{j}") < F.col("_v"), 2).when(F.col(f"_s._{j}") == F.col("_v"), 1).otherwise(0) for j in ends])
    values = values.select(*keys, "_c", slot.alias("_slot"))
    counted = values.groupBy(*keys, "_c", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    listed = counted.groupBy(*keys).agg(F.collect_list(F.struct("_c", "_slot", "_n")).alias("_slots"))
    found = same_group_join(with_edges, listed, keys)
    return found.select(*keys, *[x for i, v in enumerate(columns) for x in (F.col(f"{v}_n"), F.col(f"{v}_gaps"), _updated(v, i).alias(f"{v}_b"))])


def _updated(v: str, i: int) -> Column:
    """The brackets of a column after its values have been counted by slot."""
    edges = F.col(f"{v}_e")
    slots = F.array_sort(F.transform(F.filter("_slots", lambda s: s["_c"] == i), lambda s: F.struct(s["_slot"].alias("slot"), s["_n"].alias("n"))))

    def update(b: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("bigint").alias("n"))

        def step(seen, s):
            hit = seen["slot"].isNull() & (b["rank"] < seen["below"] + s["n"])
            passed = F.when(seen["slot"].isNull() & ~hit, seen["below"] + s["n"]).otherwise(seen["below"])
            return F.struct(passed.alias("below"), F.when(hit, s["slot"]).otherwise(seen["slot"]).alias("slot"), F.when(hit, s["n"]).otherwise(seen["n"]).alias("n"))

        at = F.aggregate(slots, start, step)
        edge = F.floor(at["slot"] / 2).cast("int")
        exact = at["slot"] % 2 == 1
        lo, hi = F.coalesce(F.get(edges, edge - 1), F.lit(float("-inf"))), F.coalesce(F.get(edges, edge), F.lit(float("inf")))
        # the slot may reach beyond the bracket where only other ranks have edges
        below = F.when(lo >= b["lo"], at["below"]).otherwise(b["below"])
        upto = F.when(hi <= b["hi"], at["below"] + at["n"]).otherwise(b["below"] + b["inside"])
        narrowed = F.struct(
            b["rank"].alias("rank"), F.greatest(lo, b["lo"]).alias("lo"), F.least(hi, b["hi"]).alias("hi"), below.alias("below"), (upto - below).alias("inside"),
            F.when(exact, F.get(edges, edge)).alias("value"),
        )
        return F.when(_open(b) & at["slot"].isNotNull(), narrowed).otherwise(b)

    return F.transform(f"{v}_b", update)


def _picked(meet, state: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """The values at the ranks that no edge has hit: those between the edges are counted and put in order."""
    # a row per value first, the ranks of few values after: an expression over all columns and ranks is too long to be compiled
    ranks = range(len(RANKS))
    wanted = lambda v, j, x: F.when(_open(F.col(f"{v}_b")[j]), x)
    sides = {v: [wanted(v, j, F.col(f"{v}_b")[j][side]).alias(f"_{side}{j}") for j in ranks for side in ("lo", "hi")] for v in names.values()}
    ats = {v: F.array(*[wanted(v, j, F.col(f"{v}_b")[j]["rank"] - F.col(f"{v}_b")[j]["below"]) for j in ranks]).alias("_ats") for v in names.values()}
    around = state.select(*keys, *[F.struct(*sides[v], ats[v]).alias(f"{v}_s") for v in names.values()])
    cells = [F.struct(F.lit(i).alias("_c"), F.col(v).alias("_v"), F.col(f"{v}_s").alias("_s")) for i, v in enumerate(names.values())]
    values = meet(around).select(*keys, F.inline(F.array(*cells))).where("_v is not null")
    hits = [_between(F.col("_v"), {side: F.col(f"_s._{side}{j}") for side in ("lo", "hi")}) for j in ranks]
    near = values.where(reduce(lambda a, b: a | b, hits))
    places = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(j).alias("_j"), F.col("_s._ats")[j].alias("_at"))) for j, hit in enumerate(hits)]))
    listed = near.select(*keys, "_c", "_v", F.inline(places))
    inside = listed.groupBy(*keys, "_c", "_j", "_at", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys, "_c", "_j").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    hit = inside.withColumn("_upto", upto).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    listed = hit.groupBy(*keys).agg(F.collect_list(F.struct("_c", "_j", "_v")).alias("_found"))
    both = same_group_join(state, listed, keys, "left")
    stats = []
    for i, (c, v) in enumerate(names.items()):
        values = []
        for j in range(len(RANKS)):
            here = F.filter("_found", lambda f: (f["_c"] == i) & (f["_j"] == j))  # noqa: B023
            values.append(F.coalesce(F.col(f"{v}_b")[j]["value"], F.get(here, F.lit(0))["_v"]))
        stats.append(from_ranks(values, F.col(f"{v}_n"), F.col(f"{v}_gaps")).alias(f"_{c}_stats"))
    return cut_lineage(both.select(*keys, *stats))
