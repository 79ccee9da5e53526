"""Who may see what, as tables over all users."""

from pyspark.sql import Column, DataFrame, functions as F

from .catalog import DATASET, VISUALISATION, Catalog

# Strongest reason first.
OWNER, PUBLIC, SHARED = "owner", "public", "shared"


def _reason(owner: Column, is_public: Column, shared: Column) -> Column:
    return F.when(owner, OWNER).when(is_public, PUBLIC).when(shared, SHARED)


def _shares_of(cat: Catalog, object_type: str) -> DataFrame:
    rows = cat.shares.where(F.col("object_type") == object_type)
    return rows.select(F.col("target_id").alias("user_id"), "object_id")


def _shared_pairs(cat: Catalog, object_type: str) -> DataFrame:
    return _shares_of(cat, object_type).distinct()


def _access(objects: DataFrame, shared: DataFrame) -> DataFrame:
    """Objects (object_id, owner_id, is_public) and share pairs to one row per user and object.

    A public object is one row without user instead of one row per user. Shares are reduced to
    distinct pairs before they meet the objects.
    """
    anyone = F.struct(F.lit(None).cast("bigint").alias("user_id"), F.lit(PUBLIC).alias("reason"))
    owner = F.struct(F.col("owner_id").alias("user_id"), F.lit(OWNER).alias("reason"))
    seers = F.when(F.col("is_public"), F.array(owner, anyone)).otherwise(F.array(owner))
    own = objects.select(F.inline(seers), "object_id", "is_public")
    by_share = (
        shared.join(objects, "object_id")
        .where(F.col("user_id") != F.col("owner_id"))
        .select("user_id", "object_id", F.when(F.col("is_public"), PUBLIC).otherwise(SHARED).alias("reason"), "is_public")
    )
    return own.unionByName(by_share)


def _visible_visualisations(cat: Catalog) -> DataFrame:
    datasets = cat.datasets.select(F.col("id").alias("dataset_id"), F.col("user_id").alias("owner_id"), "is_public")
    return cat.visualisations.select(F.col("id").alias("object_id"), "dataset_id").join(datasets, "dataset_id").drop("dataset_id")


def _visible_datasets(cat: Catalog) -> DataFrame:
    return cat.datasets.select(F.col("id").alias("object_id"), F.col("user_id").alias("owner_id"), "is_public")


def dataset_access(cat: Catalog) -> DataFrame:
    """(user_id, dataset_id, reason, is_public): owner before public before shared."""
    return _access(_visible_datasets(cat), _shared_pairs(cat, DATASET)).withColumnRenamed("object_id", "dataset_id")


def visualisation_access(cat: Catalog) -> DataFrame:
    """The same for dashboards; visibility follows the dataset, shares are those of the dashboard."""
    edges = _access(_visible_visualisations(cat), _shared_pairs(cat, VISUALISATION))
    return edges.withColumnRenamed("object_id", "visualisation_id")


def _check(requests: DataFrame, objects: DataFrame, shared: DataFrame) -> DataFrame:
    """Requests (user_id, object_id) with ``allowed`` and ``reason``; unknown objects are refused.

    Requests and shares meet in one aggregate over their pairs: a task holds each pair once, instead of both sides distinct and in order for a join.
    """
    asked = requests.select("user_id", "object_id", F.lit(True).alias("asked"), F.lit(False).alias("has_share"))
    # ids without a value match nothing
    given = shared.where("user_id is not null and object_id is not null").select("user_id", "object_id", F.lit(False).alias("asked"), F.lit(True).alias("has_share"))
    pairs = asked.unionByName(given).groupBy("user_id", "object_id").agg(F.max("asked").alias("asked"), F.max("has_share").alias("has_share"))
    marked = pairs.where("asked").drop("asked")
    reason = _reason(F.col("owner_id") == F.col("user_id"), F.col("is_public"), F.col("has_share") & F.col("owner_id").isNotNull())
    judged = marked.join(objects, "object_id", "left").select("user_id", "object_id", reason.alias("reason"))
    return judged.select("user_id", "object_id", F.col("reason").isNotNull().alias("allowed"), "reason")


def can_view_dataset(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Owner, public or shared with the user."""
    return _check(requests, _visible_datasets(cat), _shares_of(cat, DATASET))


def can_view_visualisation(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Owner of the dataset, dataset public, or the dashboard itself shared; a share of the dataset is not enough."""
    return _check(requests, _visible_visualisations(cat), _shares_of(cat, VISUALISATION))
