"""A stored table of datasets: rows are appended, ids are given out once, earlier rows stay."""

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.catalog import DATASET_SCHEMA


@dataclass(frozen=True)
class Upload:
    """What is known of a dataset besides its rows."""

    user_id: int
    original_filename: str
    file_path: str
    file_type: str
    is_public: bool = False


def read_datasets(spark: SparkSession, table: str) -> DataFrame:
    """The registered datasets; none if nothing has been registered yet."""
    try:
        return spark.read.schema(DATASET_SCHEMA).parquet(f"{table}/rows")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DATASET_SCHEMA)


def add_existing(table: str, datasets: DataFrame) -> None:
    """Append rows that have ids already, such as those of another catalog."""
    known = datasets.sparkSession.createDataFrame([], DATASET_SCHEMA).unionByName(datasets, allowMissingColumns=True)
    known.select(*[F.col(f.name).cast(f.dataType) for f in read_datasets(datasets.sparkSession, table).schema]).write.mode("append").parquet(f"{table}/rows")


def _claim(spark: SparkSession, table: str, number: int) -> bool:
    """Take an id by making a file of its name, which the file system lets one writer do only."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/ids/{number}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.create(path, False).close()
    except Py4JJavaError:
        if files.exists(path):
            return False
        raise
    return True


def append_dataset(spark: SparkSession, table: str, upload: Upload, n_rows: int, n_columns: int) -> int:
    """Register a dataset and return its id, the next free one; two writers never get the same."""
    number = (read_datasets(spark, table).agg(F.max("id")).first()[0] or 0) + 1
    while not _claim(spark, table, number):
        number += 1
    name = upload.file_path.rsplit("/", 1)[-1]
    row = (number, upload.user_id, name, upload.original_filename, upload.file_path, upload.file_type, n_rows, n_columns, upload.is_public)
    known = spark.createDataFrame([row], DATASET_SCHEMA.rsplit(",", 1)[0]).withColumn("uploaded_at", F.current_timestamp())
    known.coalesce(1).write.mode("append").parquet(f"{table}/rows")
    return number
