"""Any page of a gallery at once: rows stored in listing order with running counts, so that page N reads the places that it shows.

Rows lie sorted by viewer and newest first in files of one range each. A row's place is its range and its number in it; for every viewer and
range there is one row of the index. A page by number is found by adding up the index rows of its viewer, one per range that holds rows of them,
and read by a pushed-down filter on places, whatever the number of the page.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.kinds import quoted
from .catalog import PAGE_SIZE

PLACE = "_place"
# Places are numbered by monotonically_increasing_id: the range above, the number within it below.
RANGE_BITS = 33


@dataclass(frozen=True)
class Gallery:
    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")


def write_gallery(df: DataFrame, path: str, viewer: str = "viewer_id", order: str = "created_at", key: str = "id") -> Gallery:
    """Sort the listings of all viewers by ranges; the gallery of one viewer may span many of them.

    Rows without a viewer are in no gallery. Times that are missing come last, equal ones by larger ``key`` first. An empty table has no pages.
    Only the narrow index is aggregated; the sorted rows are written once and not read again but for its two columns.
    """
    if PLACE in df.columns:
        raise ValueError(f"a column is named {PLACE}")
    by = [quoted(viewer), F.desc_nulls_last(quoted(order)), F.desc_nulls_last(quoted(key))]
    ranges = df.where(quoted(viewer).isNotNull()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranges.withColumn(PLACE, F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
    gallery = Gallery(df.sparkSession, path)
    counted = gallery.rows().groupBy(quoted(viewer).alias("viewer"), F.shiftright(PLACE, RANGE_BITS).alias("part"))
    index = counted.agg(F.min(PLACE).alias("first"), F.count(F.lit(1)).alias("n"))
    index.repartitionByRange("viewer", "part").sortWithinPartitions("viewer", "part").write.mode("overwrite").parquet(f"{path}/index")
    return gallery


def gallery_total(gallery: Gallery, viewer: int) -> int:
    """How many rows the viewer's gallery has, from the index."""
    return gallery.index().where(F.col("viewer") == viewer).agg(F.sum("n")).first()[0] or 0


def gallery_page_at(gallery: Gallery, viewer: int, number: int = 1, per_page: int = PAGE_SIZE) -> DataFrame:
    """One page of a viewer's gallery, newest first; pages below 1 count as the first, pages past the end are empty.

    To the driver come the index rows of the viewer, at most one per range.
    """
    start = (max(number, 1) - 1) * per_page
    end, before, spans = start + per_page, 0, []
    for row in gallery.index().where(F.col("viewer") == viewer).orderBy("part").collect():
        low, high = max(start - before, 0), min(end - before, row["n"])
        if low < high:
            spans.append((row["first"] + low, row["first"] + high - 1))
        before += row["n"]
    places = [F.col(PLACE).between(low, high) for low, high in spans]
    rows = gallery.rows()
    found = rows.where(reduce(lambda a, b: a | b, places)) if places else rows.limit(0)
    # at most per_page rows are ordered
    return found.orderBy(PLACE).limit(per_page).drop(PLACE)
