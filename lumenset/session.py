"""Shared folder and lineage helpers."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.kinds import ROW_ID, quoted


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenset-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads see the same rows even if executors are lost."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def with_row_order(df: DataFrame, order_by: str | list[str] | None) -> tuple[DataFrame, Column]:
    """The table and its sort key for row-order semantics; scan order if the caller names no column."""
    if order_by is None:
        if ROW_ID not in df.columns:
            df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
        return df, F.col(ROW_ID)
    names = [order_by] if isinstance(order_by, str) else order_by
    columns = [quoted(n) for n in names]
    return df, F.struct(*columns) if len(columns) > 1 else columns[0]
