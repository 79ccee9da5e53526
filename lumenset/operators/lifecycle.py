"""Changes to the catalog as new versions of its tables, and the integrity report."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.kinds import quoted
from .catalog import DATASET, VISUALISATION, Catalog

SHARE_KEY = ["owner_id", "target_id", "object_type", "object_id"]


def grant(shares: DataFrame, new: DataFrame) -> DataFrame:
    """Add the shares that do not exist yet; granting twice changes nothing. Of a share given several times the smallest row counts."""
    rest = [c for c in new.columns if c not in SHARE_KEY]
    once = new.groupBy(SHARE_KEY).agg(F.min(F.struct(*[quoted(c) for c in rest])).alias("_first")) if rest else new.select(SHARE_KEY).distinct()
    once = once.select(*[F.col("_first").getField(c).alias(c) if c in rest else F.col(c) for c in new.columns])
    fresh = once.join(shares.select(SHARE_KEY), SHARE_KEY, "left_anti")
    return shares.unionByName(fresh, allowMissingColumns=True)


def revoke(shares: DataFrame, keys: DataFrame) -> DataFrame:
    return shares.join(keys.select(SHARE_KEY), SHARE_KEY, "left_anti")


def _without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is not among ``ids.id``; rows without a value stay."""
    return df.join(ids.select(F.col("id").alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")


def delete_visualisations(cat: Catalog, ids: DataFrame) -> Catalog:
    """Dashboards go with their own shares."""
    gone = ids.select(F.col("id").alias("object_id"), F.lit(VISUALISATION).alias("object_type"))
    return cat.replace(
        shares=cat.shares.join(gone, ["object_type", "object_id"], "left_anti"),
        visualisations=_without(cat.visualisations, "id", ids),
    )


def delete_datasets(cat: Catalog, ids: DataFrame) -> Catalog:
    """Datasets go with their dashboards; shares stay behind, as the integrity report shows."""
    return cat.replace(
        visualisations=_without(cat.visualisations, "dataset_id", ids),
        datasets=_without(cat.datasets, "id", ids),
    )


def delete_users(cat: Catalog, ids: DataFrame) -> Catalog:
    """Accounts go with shares given or received, their datasets and the dashboards on those."""
    users = ids.select(F.col("id").alias("user_id"))
    datasets = cat.datasets.join(users, "user_id", "left_semi").select("id")
    return delete_datasets(cat, datasets).replace(
        users=_without(cat.users, "id", ids),
        shares=_without(_without(cat.shares, "owner_id", ids), "target_id", ids),
    )


def toggle_public(datasets: DataFrame, ids: DataFrame) -> DataFrame:
    """Flip the public flag of the given datasets."""
    marked = ids.select(F.col("id").alias("_flip")).distinct()
    joined = datasets.join(marked, datasets["id"] == marked["_flip"], "left")
    flipped = F.when(F.col("_flip").isNotNull(), ~F.col("is_public")).otherwise(F.col("is_public"))
    return joined.withColumn("is_public", flipped).drop("_flip")


def integrity_report(cat: Catalog) -> DataFrame:
    """(issue, object_type, object_id, detail, n): orphaned shares, repeated shares, repeated e-mails."""
    known = cat.datasets.select(F.lit(DATASET).alias("object_type"), F.col("id").alias("object_id")).unionByName(
        cat.visualisations.select(F.lit(VISUALISATION).alias("object_type"), F.col("id").alias("object_id"))
    )
    orphans = (
        cat.shares.groupBy("object_type", "object_id").agg(F.count("*").alias("n"))
        .join(known, ["object_type", "object_id"], "left_anti")
        .select(F.lit("orphaned share").alias("issue"), "object_type", "object_id", F.lit(None).cast("string").alias("detail"), "n")
    )
    pair = F.concat_ws("->", F.col("owner_id").cast("string"), F.col("target_id").cast("string"))
    # nearly all shares differ: they are put in order, which may spill, and not held in an aggregate by the tasks that read or join them
    same = W.partitionBy(SHARE_KEY).orderBy(SHARE_KEY)
    whole = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    numbered = cat.shares.select(*SHARE_KEY, F.row_number().over(same).alias("_row"), F.count(F.lit(1)).over(whole).alias("n"))
    repeated = (
        numbered.where("_row = 1 and n > 1")
        .select(F.lit("repeated share").alias("issue"), "object_type", "object_id", pair.alias("detail"), "n")
    )
    emails = (
        cat.users.groupBy("email").agg(F.count("*").alias("n")).where("n > 1")
        .select(F.lit("repeated e-mail").alias("issue"), F.lit("user").alias("object_type"), F.lit(None).cast("bigint").alias("object_id"), F.col("email").alias("detail"), "n")
    )
    return orphans.unionByName(repeated).unionByName(emails)
