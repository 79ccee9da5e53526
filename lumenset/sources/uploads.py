"""Which files in a folder may be taken in."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.kinds import quoted

# Accepted extensions and the largest accepted file.
ACCEPTED = ["csv", "json"]
MAX_BYTES = 50 * 1024 * 1024


def extension(name: Column) -> Column:
    """Text after the last dot in lower case, empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def check_uploads(files: DataFrame, name: str, length: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``ext``, ``accepted`` and ``reason`` to a table of file names and sizes."""
    ext = extension(quoted(name))
    bad_type = F.concat(F.lit("Unsupported file type: "), ext)
    reason = F.when(~ext.isin(ACCEPTED), bad_type).when(quoted(length) > max_bytes, "File too large")
    return files.select("*", ext.alias("ext"), reason.isNull().alias("accepted"), reason.alias("reason"))


def upload_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, ext, accepted, reason) of the files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(folder)
    return check_uploads(files.select(F.substring_index("path", "/", -1).alias("name"), "length"), "name", "length")
