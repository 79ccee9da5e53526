"""Access kept up to date: every reason to see an object with its multiplicity, changed by signed rows.

A reason is a row (object_type, dataset_id, object_id, user_id, reason, granter_id, n): an object has one ``owner`` row, a ``public`` row while it
is public (no user, the owner as granter) and a ``shared`` row per granter and receiver that counts the shares. Every change of the catalog
becomes rows with positive or negative ``n``, stored as a batch of its own. Adding up the batches gives the reasons of now; the tables of the
catalog are not read again. Functions that compute a change take the rows of all batches and add up only those that it touches, which are found where
they are read, without a shuffle of the others, unless the ids in question lie too far apart.

A missing public flag counts as not public. Objects without an id and dashboards of unknown datasets have no owner row; shares of unknown
objects are kept, as in the catalog, and count again once the object exists. Ids without a value match nothing. Dataset and dashboard ids are unique.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .access import OWNER, PUBLIC, SHARED, _access
from .catalog import DATASET, VISUALISATION, Catalog
from .joins import among
from .lifecycle import SHARE_KEY

KEY = ["object_type", "dataset_id", "object_id", "user_id", "reason", "granter_id"]
REASONS = "object_type string, dataset_id bigint, object_id bigint, user_id bigint, reason string, granter_id bigint, n bigint"


def _rows(**values: Column) -> Column:
    kinds = dict(part.split(" ") for part in REASONS.split(", "))
    return F.struct(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def _object_rows(objects: DataFrame, object_type: str) -> DataFrame:
    """Owner and public rows of objects (dataset_id, object_id, owner_id, is_public)."""
    same = {"object_type": F.lit(object_type), "dataset_id": F.col("dataset_id"), "object_id": F.col("object_id"), "n": F.lit(1)}
    owner = _rows(**same, user_id=F.col("owner_id"), reason=F.lit(OWNER))
    public = _rows(**same, reason=F.lit(PUBLIC), granter_id=F.col("owner_id"))
    rows = F.when(F.col("is_public"), F.array(owner, public)).otherwise(F.array(owner))
    return objects.where("object_id is not null").select(F.inline(rows))


def _share_rows(shares: DataFrame) -> DataFrame:
    """Shares (SHARE_KEY and n) as reasons; they know no dataset."""
    return shares.select(F.inline(F.array(_rows(
        object_type=F.col("object_type"), object_id=F.col("object_id"), user_id=F.col("target_id"), reason=F.lit(SHARED),
        granter_id=F.col("owner_id"), n=F.col("n"),
    ))))


def added_datasets(datasets: DataFrame) -> DataFrame:
    """The change that new datasets (id, user_id, is_public) make."""
    return _object_rows(datasets.select(F.col("id").alias("dataset_id"), F.col("id").alias("object_id"), F.col("user_id").alias("owner_id"), "is_public"), DATASET)


def added_visualisations(reasons: DataFrame, visualisations: DataFrame) -> DataFrame:
    """The change that new dashboards (id, dataset_id) on known datasets make."""
    mine = reasons.where((F.col("object_type") == DATASET) & F.col("reason").isin(OWNER, PUBLIC))
    wanted = visualisations.select("dataset_id").distinct()
    datasets = _objects(merged(mine.join(wanted, "dataset_id", "left_semi")))
    boards = visualisations.select(F.col("id").alias("object_id"), "dataset_id")
    return _object_rows(boards.join(datasets.drop("object_id", "object_type"), "dataset_id"), VISUALISATION)


def all_reasons(cat: Catalog) -> DataFrame:
    """The reasons of a whole catalog, the first batch. Shares that repeat have a row each."""
    datasets = added_datasets(cat.datasets)
    shares = cat.shares.select(*SHARE_KEY, F.lit(1).alias("n"))
    return datasets.unionByName(added_visualisations(datasets, cat.visualisations)).unionByName(_share_rows(shares))


def _asked(reasons: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of shares (SHARE_KEY), once each, with the ``n`` of now: one aggregate over both. Keys are read several times, so they are stored."""
    spark, path = keys.sparkSession, scratch_path(keys.sparkSession, "asked")
    keys.select(*[F.col(c).cast("string" if c == "object_type" else "bigint") for c in SHARE_KEY]).write.parquet(path)
    asked = spark.read.schema("owner_id bigint, target_id bigint, object_type string, object_id bigint").parquet(path)
    mine = reasons.where(F.col("reason") == SHARED).select(F.col("granter_id").alias("owner_id"), F.col("user_id").alias("target_id"), "object_type", "object_id", "n")
    for column in ("object_id", "target_id"):
        mine = among(mine, column, asked.select(F.col(column).alias("id")))
    both = mine.dropna(subset=SHARE_KEY).withColumn("_asked", F.lit(False)).unionByName(asked.withColumns({"n": F.lit(0).cast("bigint"), "_asked": F.lit(True)}))
    counted = both.repartition("object_id", "target_id").groupBy(SHARE_KEY).agg(F.sum("n").alias("n"), F.max("_asked").alias("_asked"))
    return counted.where("_asked").drop("_asked")


def granted(reasons: DataFrame, new: DataFrame) -> DataFrame:
    """Shares (SHARE_KEY) that do not exist yet, once each."""
    return _share_rows(_asked(reasons, new).where("n = 0").withColumn("n", F.lit(1)))


def _negated(rows: DataFrame) -> DataFrame:
    return merged(rows).select(*KEY, (-F.col("n")).alias("n"))


def revoked(reasons: DataFrame, keys: DataFrame) -> DataFrame:
    """Shares go by their keys (SHARE_KEY), however often they were given."""
    return _share_rows(_asked(reasons, keys.dropna(subset=SHARE_KEY)).where("n <> 0").withColumn("n", -F.col("n")))


def _touched(reasons: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    return among(reasons, column, ids.select(F.col("id").cast("bigint")), how)


def without_visualisations(reasons: DataFrame, ids: DataFrame) -> DataFrame:
    """Dashboards go with their own shares."""
    return _negated(_touched(reasons.where(F.col("object_type") == VISUALISATION), "object_id", ids))


def without_datasets(reasons: DataFrame, ids: DataFrame) -> DataFrame:
    """Datasets go with their dashboards; shares, which know no dataset, stay behind."""
    return _negated(_touched(reasons, "dataset_id", ids))


def without_users(reasons: DataFrame, ids: DataFrame) -> DataFrame:
    """Accounts go with what they own, grant and receive. Public rows have the owner as granter."""
    received = _touched(reasons, "user_id", ids)
    given = _touched(_touched(reasons, "granter_id", ids), "user_id", ids, "left_anti")
    return _negated(received.unionByName(given))


def _objects(rows: DataFrame) -> DataFrame:
    """(object_type, dataset_id, object_id, owner_id, is_public) from owner and public rows."""
    return rows.groupBy("object_type", "dataset_id", "object_id").agg(
        F.max(F.when(F.col("reason") == OWNER, F.col("user_id"))).alias("owner_id"), F.max(F.col("reason") == PUBLIC).alias("is_public")
    )


def flipped(reasons: DataFrame, ids: DataFrame) -> DataFrame:
    """Flip the public flag of datasets, and so of their dashboards."""
    # an object has few rows of its own: dealt by object, not by a dataset that may be hot, they are added up and make objects in one place
    objects = _objects(_sums(_touched(reasons.where(F.col("reason").isin(OWNER, PUBLIC)), "dataset_id", ids).repartition("object_id")))
    sign = F.when(F.col("is_public"), -1).otherwise(1)
    return objects.select(F.inline(F.array(_rows(
        object_type=F.col("object_type"), dataset_id=F.col("dataset_id"), object_id=F.col("object_id"), reason=F.lit(PUBLIC), granter_id=F.col("owner_id"), n=sign,
    ))))


def _sums(changes: DataFrame) -> DataFrame:
    return changes.groupBy(KEY).agg(F.sum("n").alias("n")).where("n <> 0")


def merged(changes: DataFrame) -> DataFrame:
    """Reasons of now from signed rows; reasons that cancel out are gone.

    Rows are dealt by object and user before they are added up: few of them repeat, so tasks that read them need not hold them in an aggregate first. Rows
    that a join has dealt by a hot dataset or user alone are dealt anew, so that join may be split, and pairs of user and object are in one place afterwards.
    """
    return _sums(changes.repartition("object_id", "user_id"))


def add_batch(changes: DataFrame, path: str, batch: int) -> None:
    """Store a change under its number; a batch that is stored again replaces what it was before."""
    changes.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before a batch, from which that batch can be computed again."""
    rows = spark.read.schema(REASONS).parquet(path)
    return (rows if before is None else rows.where(F.col("batch") < before)).select(*KEY, "n")


def granted_before(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Shares (SHARE_KEY) that batches before this one have granted, those revoked again included. They may repeat."""
    shares = read_batches(spark, path, batch).where((F.col("reason") == SHARED) & (F.col("n") > 0))
    return shares.select(F.col("granter_id").alias("owner_id"), F.col("user_id").alias("target_id"), "object_type", "object_id")


def read_reasons(spark: SparkSession, path: str) -> DataFrame:
    """Reasons of now."""
    return merged(read_batches(spark, path))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """All batches as one in a new folder; the old one stays as it is until the caller changes over."""
    add_batch(read_reasons(spark, path), to, 0)


def rights(reasons: DataFrame, object_type: str) -> DataFrame:
    """(user_id, object_id, reason, is_public) as ``dataset_access`` and ``visualisation_access`` give it, from reasons alone."""
    mine = reasons.where(F.col("object_type") == object_type)
    # the condition, which all of them meet, is the one that the join with shares adds; so Spark shuffles objects once for both of their uses
    objects = _objects(mine.where(F.col("reason").isin(OWNER, PUBLIC) & F.col("object_id").isNotNull())).select("object_id", "owner_id", "is_public")
    return _access(objects, mine.where(F.col("reason") == SHARED).select("user_id", "object_id").distinct())
