"""Dashboard feeds from one cube instead of the rows: every filter on its dimensions is answered from stored sums.

The rows are aggregated once to their finest cells, a partial aggregate; coarser cuboids are grouping sets over those cells, never over the rows.
A cell holds counts, sums and extremes, which merge. A question reads the one cuboid of its dimensions, a folder of its own.
"""

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.kinds import number, quoted
from ..session import cut_lineage
from .feeds import apply_filters, leaders

# Dimensions of which every combination gets its cuboid (2 ** 6 of them); of more, the finest cells answer all.
MOST_DIMENSIONS = 6


@dataclass(frozen=True)
class Cube:
    """Where the cuboids lie, the dimensions in their order, which of them are times (name to grain), and the measures."""

    spark: SparkSession
    path: str
    schema: StructType
    dimensions: tuple[str, ...]
    grains: dict[str, str]
    measures: tuple[str, ...]

    def cuboid(self, wanted: list[str]) -> DataFrame:
        """The cells of the smallest stored cuboid that has the wanted dimensions."""
        unknown = set(wanted) - set(self.dimensions)
        if unknown:
            raise ValueError(f"not dimensions of the cube: {sorted(unknown)}")
        kept = self.dimensions if len(self.dimensions) > MOST_DIMENSIONS else wanted
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("cuboid") == _name([d in kept for d in self.dimensions]))


def _name(kept: list[bool]) -> str:
    return "c" + "".join("1" if k else "0" for k in kept)


def _merge(measures: tuple[str, ...]) -> list[Column]:
    parts = [F.sum("rows").alias("rows")]
    for i, _ in enumerate(measures):
        parts += [F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"sum{i}").alias(f"sum{i}"), F.min(f"min{i}").alias(f"min{i}"), F.max(f"max{i}").alias(f"max{i}")]
    return parts


def build_cube(df: DataFrame, dimensions: list[str], measures: list[str], path: str, times: dict[str, tuple[str, str]] | None = None) -> Cube:
    """Write the cube of ``df``; ``times`` names further dimensions as (column, grain). Null is a value of a dimension like others.

    The rows are scanned once. With more than MOST_DIMENSIONS dimensions only the finest cells are kept. An empty table gives a cube without cells.
    """
    times = times or {}
    if not dimensions and not times:
        raise ValueError("a cube needs a dimension")
    clash = set(dimensions) & set(times)
    if clash:
        raise ValueError(f"a dimension and a time have one name: {sorted(clash)}")
    names = (*dimensions, *times)
    stored = tuple(measures)
    inner = [f"d{i}" for i in range(len(names))]
    values = [quoted(d) for d in dimensions] + [F.date_trunc(grain, quoted(c).cast("timestamp")) for c, grain in times.values()]
    numbers = [number(df, m).alias(f"m{i}") for i, m in enumerate(measures)]
    narrow = df.select(*[v.alias(d) for v, d in zip(values, inner)], *numbers)
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, _ in enumerate(measures):
        v = F.col(f"m{i}")
        parts += [F.count(v).alias(f"n{i}"), F.sum(v).alias(f"sum{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    cells = cut_lineage(narrow.groupBy(*inner).agg(*parts))
    # the finest cells are a grouping set as well, so one write replaces all that was there
    sizes = range(len(inner) + 1) if len(inner) <= MOST_DIMENSIONS else [len(inner)]
    sets = [list(s) for size in sizes for s in combinations(inner, size)]
    kept = [F.when(F.grouping(d) == 0, "1").otherwise("0") for d in inner]
    cuboids = cells.groupingSets(sets, *inner).agg(F.concat(F.lit("c"), *kept).alias("cuboid"), *_merge(stored))
    cuboids.hint("rebalance", "cuboid").write.mode("overwrite").partitionBy("cuboid").parquet(path)
    return Cube(df.sparkSession, path, cuboids.schema, names, {name: grain for name, (_, grain) in times.items()}, stored)


def _cells(cube: Cube, shown: list[str], isin: dict | None, between: dict | None) -> DataFrame:
    """The cells that a filter leaves, with the names of the dimensions as ``d<i>``."""
    isin, between = isin or {}, between or {}
    for c, ends in between.items():
        for end in ends if c in cube.grains else ():
            _check_edge(cube, c, end)
    place = {d: f"d{i}" for i, d in enumerate(cube.dimensions)}
    cells = cube.cuboid([*shown, *isin, *between])
    return apply_filters(cells, {place[c]: v for c, v in isin.items()}, {place[c]: v for c, v in between.items()})


def _check_edge(cube: Cube, name: str, end) -> None:
    if end is None:
        return
    cut = cube.spark.range(1).select(F.date_trunc(cube.grains[name], F.lit(end).cast("timestamp")) == F.lit(end).cast("timestamp")).first()[0]
    if not cut:
        raise ValueError(f"{end} is not the start of a {cube.grains[name]}, so the cube cannot tell what lies on which side of it")


def _measure(cube: Cube, name: str) -> int:
    if name not in cube.measures:
        raise ValueError(f"not a measure of the cube: {name}")
    return cube.measures.index(name)


def _shown(cube: Cube, name: str) -> Column:
    return F.col(f"d{cube.dimensions.index(name)}")


def kpis_of(cube: Cube, isin: dict | None = None, between: dict | None = None) -> DataFrame:
    """(measure, n, total, mean, min, max) as ``feeds.kpis`` gives it under the filters. Ranges of times are closed, of whole units of the grain."""
    cells = _cells(cube, [], isin, between).agg(*_merge(cube.measures))
    rows = [F.struct(
        F.lit(m).alias("measure"), F.coalesce(f"n{i}", F.lit(0)).cast("bigint").alias("n"), F.col(f"sum{i}").alias("total"),
        F.try_divide(f"sum{i}", f"n{i}").alias("mean"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
    ) for i, m in enumerate(cube.measures)]
    return cells.select(F.inline(F.array(*rows)))


def by_category_of(cube: Cube, dimension: str, measure: str, n: int = 10, isin: dict | None = None, between: dict | None = None) -> DataFrame:
    """(category, is_other, n, total, share) as ``feeds.by_category`` gives it under the filters."""
    i = _measure(cube, measure)
    cells = _cells(cube, [dimension], isin, between)
    return leaders(cells.groupBy(_shown(cube, dimension).alias("category")).agg(F.sum("rows").alias("n"), F.sum(f"sum{i}").alias("total")), n)


def by_time_of(cube: Cube, time: str, measure: str, isin: dict | None = None, between: dict | None = None) -> DataFrame:
    """(bucket, n, total, mean) as ``feeds.by_time`` gives it under the filters, by the grain of the cube."""
    i = _measure(cube, measure)
    sums = _cells(cube, [time], isin, between).groupBy(_shown(cube, time).alias("bucket"))
    sums = sums.agg(F.sum("rows").alias("n"), F.sum(f"sum{i}").alias("total"), F.sum(f"n{i}").alias("_n"))
    return sums.select("bucket", "n", "total", F.try_divide("total", "_n").alias("mean"))


def by_two_of(cube: Cube, rows: str, columns: str, measure: str, isin: dict | None = None, between: dict | None = None) -> DataFrame:
    """(row, column, n, total) as ``feeds.by_two`` gives it under the filters."""
    i = _measure(cube, measure)
    cells = _cells(cube, [rows, columns], isin, between)
    return cells.groupBy(_shown(cube, rows).alias("row"), _shown(cube, columns).alias("column")).agg(F.sum("rows").alias("n"), F.sum(f"sum{i}").alias("total"))
