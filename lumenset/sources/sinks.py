"""Write cleaned tables and register them."""

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.clean import clean
from ..session import ROW_ID
from .csv import read_csv_table
from .json import read_json_documents
from .registry import Upload, append_dataset

FORMATS = ["csv", "json", "parquet"]


def write_table(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists", partition_by: str | None = None) -> None:
    """CSV with header and without index, JSON lines with null fields, or parquet."""
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported file type: {fmt}")
    writer = df.drop(ROW_ID).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        # values keep the spaces and line breaks at their ends
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)


def register_dataset(df: DataFrame, table: str, upload: Upload) -> int:
    """Write a cleaned table in the upload's format and append its row to the stored ``table`` of datasets; returns the id.

    Rows are counted during the write.
    """
    counted = Observation(f"rows-{uuid.uuid4().hex}")
    out = df.drop(ROW_ID)
    write_table(out.observe(counted, F.count(F.lit(1)).alias("n")), upload.file_path, upload.file_type)
    return append_dataset(df.sparkSession, table, upload, counted.get["n"], len(out.columns))


def take_upload(spark: SparkSession, path: str, table: str, upload: Upload) -> int:
    """Read an uploaded CSV or JSON file, clean it, write it to ``upload.file_path`` in its own format and register it.

    The registered counts are those of the cleaned table. Returns the dataset's id.
    """
    if upload.file_type == "csv":
        raw = read_csv_table(spark, path)
    elif upload.file_type == "json":
        raw = read_json_documents(spark, path)
    else:
        raise ValueError(f"Unsupported file type: {upload.file_type}")
    return register_dataset(clean(raw, ROW_ID), table, upload)
