"""Profiles of tables that grow: one mergeable state per column and load, merged when the profile is asked for.

A load is read once, when it arrives. Its state has one row per column: counts, extremes, mean and sum of squared deviations of
numbers (exact), a quantile sketch of them, and a sketch of distinct texts. Merging reads states only, never the rows of earlier loads.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.kinds import BOOL, DATETIME, NUMERIC, STRING, columns_of, dtype_name, number, quoted
from ..session import ROW_ID

# Size of the quantile sketch, and the rank error that it keeps to, merged or not, with a probability of 99 %.
SKETCH_SIZE = 800
RANK_ERROR = 0.005
# Binary logarithm of the buckets of the distinct sketch: a relative error of about 1.6 %.
DISTINCT_BITS = 12

STATE = (
    "position int, column string, type string, n_rows bigint, n bigint, min double, max double, mean double, m2 double, quantiles binary, "
    "distinct_texts binary, first timestamp, last timestamp"
)


def load_state(df: DataFrame) -> DataFrame:
    """The state of one load, a row per column, from one aggregate."""
    base = df.drop(ROW_ID)
    rows = []
    for place, field in enumerate(base.schema.fields):
        c, values = field.name, {}
        if c in columns_of(base, NUMERIC, BOOL):
            v = number(base, c)
            # of a column without values there is no sketch
            values = {"n": F.count(v), "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "m2": F.var_pop(v) * F.count(v)}
            values["quantiles"] = F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, SKETCH_SIZE))
        elif c in columns_of(base, STRING):
            values = {"n": F.count(quoted(c)), "distinct_texts": F.hll_sketch_agg(quoted(c).cast("string"), DISTINCT_BITS)}
        elif c in columns_of(base, DATETIME):
            stamp = quoted(c).cast("timestamp")
            values = {"n": F.count(stamp), "first": F.min(stamp), "last": F.max(stamp)}
        values |= {"position": F.lit(place), "column": F.lit(c), "type": F.lit(dtype_name(field.dataType)), "n_rows": F.count(F.lit(1))}
        fields = [part.split(" ") for part in STATE.split(", ")]
        rows.append(F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields]))
    return base.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def add_load(df: DataFrame, path: str, load: str | int) -> None:
    """Store the state of a load under its name; a load that is added again replaces what it was before."""
    load_state(df).coalesce(1).write.mode("overwrite").parquet(f"{path}/load={load}")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(path)


def merged_profile(states: DataFrame, probabilities: list[float] | None = None) -> DataFrame:
    """One row per column over all loads: position, column, type, n_rows, n, min, max, mean, std, median, quantiles, unique_values, first, last.

    Counts, extremes, mean and (sample) std are exact. The median and ``quantiles`` (at ``probabilities``) are off by RANK_ERROR of the present
    values at most, ``unique_values`` by a few per cent; a load without a column counts as rows without a value of it. A column that has had
    several types is text. Without a load there are no rows.
    """
    probabilities = probabilities or []
    # the rows of all loads, also of those without a column; one number comes to the driver
    all_rows = states.select("load", "n_rows").distinct().agg(F.sum("n_rows")).first()[0] if "load" in states.columns else None
    weight = F.sum("n")
    mean = F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))), F.lit(0))
    means = states.groupBy("column").agg(mean.alias("_mean"))
    joined = states.join(means.withColumnRenamed("column", "_of"), F.col("column") == F.col("_of"))
    deviations = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2)
    kind = F.when(F.count_distinct("type") == 1, F.min("type")).otherwise(F.lit("object"))
    merged = joined.groupBy("column").agg(
        F.min("position").alias("position"), kind.alias("type"), F.sum("n_rows").alias("n_rows"), weight.alias("n"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.max("_mean").alias("mean"), F.sqrt(deviations / F.nullif(weight - 1, F.lit(0))).alias("std"),
        F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("sketch"),
        F.when(F.count("distinct_texts") > 0, F.hll_sketch_estimate(F.hll_union_agg("distinct_texts"))).alias("unique_values"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )
    if all_rows is not None:
        merged = merged.withColumn("n_rows", F.lit(all_rows).cast("bigint"))
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
    known = lambda value: F.when(F.col("sketch").isNotNull(), value)
    quantiles = F.array(*[at(p) for p in probabilities]) if probabilities else F.array().cast("array<double>")
    return merged.select(
        "position", "column", "type", "n_rows", "n", "min", "max", "mean", "std", known(at(0.5)).alias("median"), known(quantiles).alias("quantiles"),
        "unique_values", "first", "last",
    )


def iqr_bounds_of(states: DataFrame, reach: float = 1.5) -> DataFrame:
    """(column, q1, q3, lower, upper) of the number columns over all loads, from the merged sketches."""
    found = merged_profile(states, [0.25, 0.75]).where("quantiles is not null").select("column", F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * F.lit(reach)
    return found.select("column", "q1", "q3", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper"))


def rank_errors(df: DataFrame, found: dict[str, dict[float, float]]) -> DataFrame:
    """(column, p, value, error): how far each value found for a probability lies from its rank among the present values of a table.

    The rank of a value is any between the shares of smaller and of not larger values; one aggregate for all.
    """
    rows = []
    for c, values in found.items():
        v = number(df, c)
        for p, value in values.items():
            n = F.nullif(F.count(v), F.lit(0))
            low, high = F.count_if(v < F.lit(value)) / n, F.count_if(v <= F.lit(value)) / n
            error = F.greatest(low - F.lit(p), F.lit(p) - high, F.lit(0.0))
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("p"), F.lit(float(value)).alias("value"), error.alias("error")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def known_values(merged: DataFrame, probabilities: list[float]) -> dict[str, dict[float, float]]:
    """The quantiles of a merged profile by column and probability; one row per column comes to the driver."""
    rows = merged.where("quantiles is not null").select("column", "quantiles").collect()
    return {r["column"]: dict(zip(probabilities, r["quantiles"])) for r in rows}


def within(error: Column) -> Column:
    return F.coalesce(error <= RANK_ERROR, F.lit(True))
