"""Listings over the catalog of users, datasets, dashboards and shares.

Functions that list what one user sees take ``uid`` and return a sorted listing. Without it they answer
for all users at once, unsorted, and carry the user in a ``viewer_id`` column.
"""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

# The two object types of a share, the stand-in for a missing owner, the page size.
DATASET, VISUALISATION = "dataset", "visualisation"
NO_OWNER = "Unknown"
PAGE_SIZE = 6

USER_SCHEMA = "id bigint, name string, email string, password_hash string, created_at timestamp"
DATASET_SCHEMA = (
    "id bigint, user_id bigint, filename string, original_filename string, file_path string, file_type string, "
    "n_rows bigint, n_columns int, is_public boolean, uploaded_at timestamp"
)
VISUALISATION_SCHEMA = (
    "id bigint, dataset_id bigint, title string, description string, spec string, created_at timestamp"
)
SHARE_SCHEMA = (
    "id bigint, owner_id bigint, target_id bigint, object_type string, object_id bigint, granted_at timestamp"
)


@dataclass(frozen=True)
class Catalog:
    """The four tables; columns as in the schemas above, a subset is enough for most questions."""

    users: DataFrame
    datasets: DataFrame
    visualisations: DataFrame
    shares: DataFrame

    def replace(self, **tables: DataFrame) -> "Catalog":
        return replace(self, **tables)


def _newest(df: DataFrame, column: str, one: int | None) -> DataFrame:
    """Newest first, for the listing of one user or dataset."""
    return df if one is None else df.orderBy(F.desc(column), F.desc("id"))


def _mine(df: DataFrame, column: str, uid: int | None) -> DataFrame:
    return df if uid is None else df.where(F.col(column) == uid)


def _shares_of(cat: Catalog, object_type: str, uid: int | None) -> DataFrame:
    rows = _mine(cat.shares.where(F.col("object_type") == object_type), "target_id", uid)
    return rows.select(F.col("target_id").alias("viewer_id"), "object_id")


def datasets_owned(cat: Catalog, uid: int | None = None) -> DataFrame:
    """A user's datasets, newest first."""
    mine = _mine(cat.datasets, "user_id", uid).withColumn("viewer_id", F.col("user_id"))
    return _newest(mine, "uploaded_at", uid)


def datasets_shared_with(cat: Catalog, uid: int | None = None) -> DataFrame:
    """Datasets others shared with a user, newest first, with the owner's name; each one once."""
    owners = cat.users.select(F.col("id").alias("user_id"), F.col("name").alias("owner"))
    shared = _shares_of(cat, DATASET, uid).distinct().join(cat.datasets, F.col("object_id") == F.col("id")).drop("object_id")
    named = shared.join(owners, "user_id", "left").withColumn("owner", F.coalesce("owner", F.lit(NO_OWNER)))
    return _newest(named, "uploaded_at", uid)


def datasets_public(cat: Catalog, uid: int) -> DataFrame:
    """Public datasets of others that are not shared with the user already, newest first."""
    theirs = cat.datasets.where(F.col("is_public") & (F.col("user_id") != uid))
    seen = _shares_of(cat, DATASET, uid).select(F.col("object_id").alias("id"))
    return _newest(theirs.join(seen, "id", "left_anti"), "uploaded_at", uid)


def shared_with(cat: Catalog, object_type: str, owner: int | None = None, object_id: int | None = None) -> DataFrame:
    """Users that an object is shared with by its owner; for all objects unless one is given."""
    rows = _mine(cat.shares.where(F.col("object_type") == object_type), "owner_id", owner)
    rows = _mine(rows, "object_id", object_id).select("owner_id", "object_id", "target_id").distinct()
    targets = cat.users.select(F.col("id").alias("target_id"), "name")
    return rows.join(targets, "target_id")


def other_users(cat: Catalog, uid: int, *fields: str) -> DataFrame:
    """(id, name) of everybody else, with ``fields`` such as the e-mail if they are named."""
    return cat.users.where(F.col("id") != uid).select("id", "name", *fields)


def shareable_users(cat: Catalog, owner: int, object_id: int, object_type: str = VISUALISATION) -> DataFrame:
    """(id, name, email) of the users the owner has not shared the object with, by name."""
    same_object = (F.col("owner_id") == owner) & (F.col("object_type") == object_type) & (F.col("object_id") == object_id)
    taken = cat.shares.where(same_object).select(F.col("target_id").alias("id"))
    return other_users(cat, owner, "email").join(taken, "id", "left_anti").orderBy("name", "id")


def _with_dataset(cat: Catalog, visualisations: DataFrame, *fields: Column) -> DataFrame:
    datasets = cat.datasets.select(F.col("id").alias("dataset_id"), *fields)
    return visualisations.join(datasets, "dataset_id")


def visualisations_owned(cat: Catalog, uid: int | None = None) -> DataFrame:
    """Dashboards on a user's datasets, newest first, with the dataset's name."""
    name = F.col("original_filename").alias("dataset_name")
    datasets = _mine(cat.datasets, "user_id", uid).select(F.col("id").alias("dataset_id"), F.col("user_id").alias("viewer_id"), name)
    return _newest(cat.visualisations.join(datasets, "dataset_id"), "created_at", uid)


def visualisations_shared_with(cat: Catalog, uid: int | None = None) -> DataFrame:
    """Dashboards shared with a user, newest first, with dataset and owner name."""
    shared = _shares_of(cat, VISUALISATION, uid).join(cat.visualisations, F.col("object_id") == F.col("id")).drop("object_id")
    found = _with_dataset(cat, shared, "user_id", F.col("original_filename").alias("dataset_name"))
    owners = cat.users.select(F.col("id").alias("user_id"), F.col("name").alias("owner"))
    return _newest(found.join(owners, "user_id"), "created_at", uid)


def dataset_visualisations(cat: Catalog, dataset_id: int | None = None) -> DataFrame:
    """Dashboards of a dataset, newest first."""
    return _newest(_mine(cat.visualisations, "dataset_id", dataset_id), "created_at", dataset_id)


def user_counts(cat: Catalog) -> DataFrame:
    """(user_id, n_datasets, n_visualisations) for every user, zeros included.

    Dashboards are counted per dataset first, so the join moves one row per dataset.
    """
    per_dataset = cat.visualisations.groupBy(F.col("dataset_id").alias("id")).agg(F.count("*").alias("n"))
    counted = cat.datasets.select("id", "user_id").join(per_dataset, "id", "left")
    per_user = counted.groupBy("user_id").agg(
        F.count("*").alias("n_datasets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_visualisations")
    )
    zero = F.lit(0).cast("bigint")
    return cat.users.select(F.col("id").alias("user_id")).join(per_user, "user_id", "left").select(
        "user_id", F.coalesce("n_datasets", zero).alias("n_datasets"), F.coalesce("n_visualisations", zero).alias("n_visualisations")
    )


def page(df: DataFrame, order: list[Column], number: int = 1, per_page: int = PAGE_SIZE) -> DataFrame:
    """One page of a listing; pages below 1 count as the first, pages past the end are empty."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * per_page).limit(per_page)


def page_after(df: DataFrame, last: tuple | None = None, order: str = "created_at", per_page: int = PAGE_SIZE) -> DataFrame:
    """The page of a listing, newest first, that follows the row (time, id) shown last; the first page without it.

    However deep the page, only ``per_page`` rows are ordered. :func:`page` by number holds all rows before the page.
    """
    at, key = F.col(order), F.col("id")
    if last is not None:
        time, number = F.lit(last[0]).cast(df.schema[order].dataType), F.lit(last[1])
        df = df.where((at < time) | (at == time) & (key < number))
    return df.orderBy(at.desc(), key.desc()).limit(per_page)


def page_info(df: DataFrame, number: int = 1, per_page: int = PAGE_SIZE) -> DataFrame:
    """(page, total, pages, has_prev, has_next) of :func:`page`, one row."""
    number = max(number, 1)
    pages = F.ceil(F.col("total") / per_page)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(number).alias("page"), "total", pages.alias("pages"),
        F.lit(number > 1).alias("has_prev"), (pages > number).alias("has_next"),
    )


def listing(datasets: DataFrame) -> DataFrame:
    """Datasets as shown in lists: ISO time, display dates, upper-case type, visibility label."""
    at = F.col("uploaded_at")
    return datasets.select(
        "id",
        F.col("original_filename").alias("filename"),
        F.upper("file_type").alias("file_type"),
        "n_rows",
        "n_columns",
        F.when(F.col("is_public"), "Public").otherwise("Private").alias("visibility"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("uploaded_at"),
        F.date_format(at, "MMM dd, yyyy").alias("day"),
        F.date_format(at, "MMM dd, yyyy HH:mm").alias("minute"),
    )
