"""Statistics of a tenant over all its files: states per tenant and batch that merge, so that a later file is cleaned with all before it.

The state of a batch has one row per tenant with a quantile sketch of every number column, and one row per tenant, column and text with its
count. Each batch is stored under its number: one that is run again replaces what it wrote, and reads only batches before its own besides.
Rows of earlier batches are never read again. Sketches have bounded size, so a tenant with most of all rows is not gathered anywhere.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.kinds import number, quoted
from ..operators.joins import group_sizes, stats_join
from ..operators.profile_state import SKETCH_SIZE

REACH = 1.5
TENANT = "tenant"


def _checked(numbers: list[str], texts: list[str], tenant: str) -> None:
    names = [*numbers, *texts, tenant]
    if len(set(names)) < len(names) or not (numbers or texts):
        raise ValueError("name at least one column to clean, each once and without the tenant's")


def add_tenant_state(rows: DataFrame, path: str, batch: int, tenant: str, numbers: list[str], texts: list[str]) -> None:
    """Store the state of a batch of rows. Rows without a tenant are a tenant of their own."""
    keyed = rows.select(quoted(tenant).alias(TENANT), *[number(rows, c).alias(f"v{i}") for i, c in enumerate(numbers)],
                        *[quoted(c).cast("string").alias(f"t{i}") for i, c in enumerate(texts)])
    sketches = [F.when(F.count(f"v{i}") > 0, F.kll_sketch_agg_double(f"v{i}", SKETCH_SIZE)).alias(f"v{i}") for i, _ in enumerate(numbers)]
    keyed.groupBy(TENANT).agg(F.count(F.lit(1)).alias("n"), *sketches).write.mode("overwrite").parquet(f"{path}/numbers/batch={batch}")
    if texts:
        pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"t{i}").alias("value")) for i, _ in enumerate(texts)])
        values = keyed.select(TENANT, F.inline(pairs)).where("value is not null")
        values.groupBy(TENANT, "place", "value").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/texts/batch={batch}")


def _same(df: DataFrame, tenants: DataFrame | None) -> DataFrame:
    if tenants is None:
        return df
    wanted = tenants.select(F.col(TENANT).alias("_tenant")).distinct()
    return df.join(wanted, F.col(TENANT).eqNullSafe(F.col("_tenant")), "left_semi")


def tenant_statistics(spark: SparkSession, path: str, numbers: list[str], texts: list[str], upto: int, tenants: DataFrame | None = None) -> DataFrame:
    """One row per tenant over the batches up to one: tenant, n, and by place median<i>, lower<i>, upper<i> of numbers, mode<i> of texts.

    Quantiles are values of the tenant, off by ``profile_state.RANK_ERROR`` of its present values at most; counts and modes are exact, of modes that
    tie the smallest text. Only states of ``tenants`` (a column ``tenant``) are merged, if they are given.
    """
    states = _same(spark.read.parquet(f"{path}/numbers").where(F.col("batch") <= upto), tenants)
    merged = [F.when(F.count(f"v{i}") > 0, F.kll_merge_agg_double(f"v{i}")).alias(f"v{i}") for i, _ in enumerate(numbers)]
    merged = states.groupBy(TENANT).agg(F.sum("n").alias("n"), *merged)
    out = []
    for i, _ in enumerate(numbers):
        low, middle, high = (F.when(F.col(f"v{i}").isNotNull(), F.kll_sketch_get_quantile_double(f"v{i}", F.lit(p))) for p in (0.25, 0.5, 0.75))
        out += [middle.alias(f"median{i}"), (low - REACH * (high - low)).alias(f"lower{i}"), (high + REACH * (high - low)).alias(f"upper{i}")]
    found = merged.select(TENANT, "n", *out)
    if not texts:
        return found
    counted = _same(spark.read.parquet(f"{path}/texts").where(F.col("batch") <= upto), tenants)
    # grouped as one value, so that a tenant with most texts is not left to one task
    counted = counted.groupBy(F.struct(TENANT, "place", "value").alias("_key")).agg(F.sum("n").alias("n")).select("_key.*", "n")
    first = [F.min(F.when(F.col("place") == i, F.struct((-F.col("n")).alias("n"), "value")))["value"].alias(f"mode{i}") for i, _ in enumerate(texts)]
    modes = counted.groupBy(F.col(TENANT).alias("_of")).agg(*first)
    return found.join(modes, F.col(TENANT).eqNullSafe(F.col("_of")), "left").drop("_of")


def clean_with(rows: DataFrame, statistics: DataFrame, tenant: str, numbers: list[str], texts: list[str]) -> DataFrame:
    """Fill gaps of numbers (as doubles) by the tenant's median and of texts by its mode; ``<column>_outlier`` flags filled numbers beyond its bounds.

    A column without any value so far keeps its gaps and flags nothing. A column that is named like a flag is replaced by it.
    """
    sizes = group_sizes(rows, [tenant])
    width = 3 * len(numbers) + len(texts)
    named = statistics.drop("n").toDF(*[tenant if c == TENANT else f"_stat_{c}" for c in statistics.columns if c != "n"])
    joined = stats_join(rows, named, [tenant], [quoted(c) for c in rows.columns], sizes.stats_bytes(width), sizes)
    filled, flags = {}, {}
    for i, c in enumerate(numbers):
        filled[c] = F.coalesce(number(rows, c), F.col(f"_stat_median{i}"))
        flags[f"{c}_outlier"] = F.coalesce((filled[c] < F.col(f"_stat_lower{i}")) | (filled[c] > F.col(f"_stat_upper{i}")), F.lit(False))
    filled |= {c: F.coalesce(quoted(c).cast("string"), F.col(f"_stat_mode{i}")) for i, c in enumerate(texts)}
    kept = [filled.get(c, quoted(c)).alias(c) for c in rows.columns if c not in flags]
    return joined.select(*kept, *[flag.alias(c) for c, flag in flags.items()])


def run_tenant_stream(stream: DataFrame, state: str, sink: str, checkpoint: str, tenant: str, numbers: list[str], texts: list[str]) -> StreamingQuery:
    """Clean what is there batch by batch, then stop; ``sink/batch=<n>`` has the cleaned rows, each with the statistics of its tenant up to its batch."""
    _checked(numbers, texts, tenant)

    def take_in(rows: DataFrame, batch: int) -> None:
        take_batch(rows, batch, state, sink, tenant, numbers, texts)

    return stream.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take_batch(rows: DataFrame, batch: int, state: str, sink: str, tenant: str, numbers: list[str], texts: list[str]) -> None:
    add_tenant_state(rows, state, batch, tenant, numbers, texts)
    mine = rows.sparkSession.read.parquet(f"{state}/numbers/batch={batch}")
    found = tenant_statistics(rows.sparkSession, state, numbers, texts, batch, mine)
    clean_with(rows, found, tenant, numbers, texts).write.mode("overwrite").parquet(f"{sink}/batch={batch}")
