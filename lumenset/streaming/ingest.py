"""Drop-folder ingest: every arriving CSV or JSON file is read with its own types, cleaned with its own
statistics, written in its own format and registered; files that can't be read are set aside with the reason."""

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.kinds import quoted
from ..operators.catalog import DATASET_SCHEMA
from ..operators.clean_by import clean_by
from ..session import ROW_ID
from ..sources.csv import BAD, FILE, TOO_LONG, file_headers, free_names, read_csv_fields
from ..sources.infer import cast_types, fit_types_by
from ..sources.json import KEY, MAX_FIELDS, column_type, document_problem, flatten_keyed_json, members_of, parsed_document
from ..sources.sinks import write_table
from ..sources.uploads import MAX_BYTES, check_uploads

FILES_PER_BATCH = 100
# Groups of so many files that are handled side by side: their jobs are short, so one group after the other would leave most cores waiting for the driver.
GROUPS = 8
LISTED = "path string, modificationTime timestamp, length bigint, content binary"
ID = "dataset_id"


def _csv_tables(spark: SparkSession, paths: list[str], problems: dict[str, str]):
    """(rows with their file, types) of CSV files, one table per header and types."""
    headers = file_headers(spark, paths, problems)
    for path in paths:
        if path not in headers:
            problems.setdefault(path, "the file is empty")
    by_header = defaultdict(list)
    for path, header in headers.items():
        by_header[tuple(header)].append(path)
    for header, members in by_header.items():
        rows = read_csv_fields(spark, members, {p: list(header) for p in members})
        for row in rows.filter(F.col(BAD).isNotNull()).select(FILE).distinct().collect():
            problems[row[FILE]] = TOO_LONG
        good = [p for p in members if p not in problems]
        rows = rows.filter(F.col(FILE).isin(good)).drop(BAD).withColumn(ROW_ID, F.monotonically_increasing_id())
        by_types = defaultdict(list)
        found = fit_types_by(rows, FILE, list(header))
        for path in good:  # a file of a header alone has text columns
            by_types[tuple(found.get(path, {c: "string" for c in header}).items())].append(path)
        for types, same in by_types.items():
            yield cast_types(rows.filter(F.col(FILE).isin(same)), dict(types)), same


def _json_tables(spark: SparkSession, paths: list[str], problems: dict[str, str]):
    """(rows with their file, files) of JSON documents, one table per set of fields and types."""
    documents = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias(FILE), F.col("value").alias("_text"))
    variant = parsed_document(F.col("_text"))
    for row in documents.select(FILE, document_problem(variant).alias("why")).filter("why is not null").collect():
        problems[row[FILE]] = row["why"]
    good = [p for p in paths if p not in problems]
    documents = documents.filter(F.col(FILE).isin(good))
    names = flatten_keyed_json(documents, "_text", {}).select(FILE, F.explode(F.map_keys(members_of(F.col("_row")))).alias("field"))
    for row in names.groupBy(FILE).agg(F.count_distinct("field").alias("n")).filter(F.col("n") > MAX_FIELDS).collect():
        problems[row[FILE]] = f"the objects have more than {MAX_FIELDS} fields"
    good = [p for p in good if p not in problems]
    documents = documents.filter(F.col(FILE).isin(good))
    items = flatten_keyed_json(documents, "_text", {})
    fields = items.select(FILE, F.explode(members_of(F.col("_row"))).alias("field", "value"), F.col(KEY).isNotNull().alias("keyed"))
    present = F.count_if(~F.coalesce(F.is_variant_null("value"), F.lit(True)))
    found = fields.groupBy(FILE, "field").agg(F.schema_of_variant_agg("value").alias("type"), present.alias("n"), F.max("keyed").alias("keyed")).collect()
    rows_of = {r[FILE]: r["count"] for r in items.groupBy(FILE).count().collect()}
    types, keyed = defaultdict(dict), set()
    for r in sorted(found):
        kind = column_type(r["type"])
        # integers with gaps are doubles
        types[r[FILE]][r["field"]] = "double" if kind == "bigint" and r["n"] < rows_of[r[FILE]] else kind
        if r["keyed"]:
            keyed.add(r[FILE])
    by_types = defaultdict(list)
    for path in good:
        by_types[path in keyed, tuple(types[path].items())].append(path)
    for (has_key, kinds), same in by_types.items():
        rows = flatten_keyed_json(documents.filter(F.col(FILE).isin(same)), "_text", dict(kinds)).drop("_row")
        rows = rows if has_key else rows.drop(KEY)
        yield rows.toDF(*free_names(rows.columns)).withColumn(ROW_ID, F.monotonically_increasing_id()), same


def clean_files(rows: DataFrame, files: list[str]):
    """(cleaned rows, files, row counts) for tables of equal columns: each file is cleaned on its own and keeps the date columns that
    pass its gate."""
    if len(rows.columns) <= 2:  # documents without a field
        yield rows, files, {}
        return
    cleaned = clean_by(rows, FILE, order_by=ROW_ID)
    # a column that was read as integers has no gaps to fill
    cleaned = cleaned.withColumns({c: quoted(c).cast(kind) for c, kind in rows.dtypes if kind == "bigint"})
    dates = [c for c in cleaned.columns if c.endswith("_date") and c not in rows.columns]
    passed = [F.max(quoted(c).isNotNull()).alias(f"d{i}") for i, c in enumerate(dates)]
    facts = {r[FILE]: r for r in cleaned.groupBy(FILE).agg(F.count("*").alias("n"), *passed).collect()}
    by_dates = defaultdict(list)
    for path in files:
        by_dates[tuple(c for i, c in enumerate(dates) if path in facts and facts[path][f"d{i}"])].append(path)
    for kept, same in by_dates.items():
        out = cleaned.filter(F.col(FILE).isin(same)).drop(*[c for c in dates if c not in kept])
        yield out, same, {p: facts[p]["n"] for p in same if p in facts}


def ingest_stream(
    spark: SparkSession, folder: str, sink: str, checkpoint: str, user_id: int, is_public: bool = False, pattern: str = "*",
    max_bytes: int = MAX_BYTES, files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Take in the files that are there, then stop.

    ``sink/rows`` gets the cleaned rows, one folder per dataset in the format of its file; ``sink/datasets`` a row of the
    dataset table per file, ids in the order of the paths; ``sink/rejected`` (file, reason) for each that can't be taken in.
    All are written under the batch number, so a batch that is run again replaces what it wrote before.
    A batch is up to GROUPS groups of at most ``files_per_batch`` files, each handled by jobs of its own, side by side; per file, a few
    scalars and at most MAX_FIELDS field names come to the driver; a JSON file of more fields is set aside. Files without a byte are passed over.
    """

    def take_group(session: SparkSession, batch_id: int, files: dict, numbers: dict[str, int], group: int):
        """(rows of the dataset table, problems) of one group of files."""
        problems, datasets, place = {}, [], 0
        for kind, tables in (("csv", _csv_tables), ("json", _json_tables)):
            paths = [p for p, r in files.items() if r["ext"] == kind]
            for rows, same in tables(session, paths, problems) if paths else []:
                for cleaned, members, counts in clean_files(rows, same):
                    # numbers that no other group has
                    path = f"{sink}/rows/batch={batch_id}/table={place * GROUPS + group}"
                    place += 1
                    ids = F.create_map(*[F.lit(x) for p in members for x in (p, numbers[p])])
                    out = cleaned.withColumn(ID, ids[F.col(FILE)]).drop(FILE, ROW_ID)
                    write_table(out, path, kind, "overwrite", partition_by=ID)
                    for p in members:
                        at = f"{path}/{ID}={numbers[p]}"
                        datasets.append((numbers[p], user_id, at.rsplit("/", 1)[-1], files[p]["name"], at, kind, counts.get(p, 0), len(out.columns) - 1, is_public))
        return datasets, problems

    def take_in(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        listed = batch.select(F.col("path"), F.substring_index("path", "/", -1).alias("name"), "length")
        files = {r["path"]: r for r in check_uploads(listed, "name", "length", max_bytes).collect()}
        problems = {p: r["reason"] for p, r in files.items() if not r["accepted"]}
        before = _read(session, f"{sink}/datasets", DATASET_SCHEMA + ", batch bigint").filter(F.col("batch") < batch_id)
        numbers = {p: i for i, p in enumerate(sorted(files), 1 + (before.agg(F.max("id")).first()[0] or 0))}
        # neighbours, which are likely to have the same columns, are of one group
        taken = sorted((p for p, r in files.items() if r["accepted"]), key=lambda p: (files[p]["ext"], p))
        groups = [{p: files[p] for p in taken[i : i + files_per_batch]} for i in range(0, len(taken), files_per_batch)]
        datasets = []
        with ThreadPoolExecutor(GROUPS) as pool:
            # each thread gets the job group and the properties of this one
            started = [pool.submit(inheritable_thread_target(session)(take_group), session, batch_id, group, numbers, i) for i, group in enumerate(groups)]
            for done in started:
                rows, refused = done.result()
                datasets += rows
                problems.update(refused)
        known = session.createDataFrame(datasets, DATASET_SCHEMA.rsplit(",", 1)[0]).withColumn("uploaded_at", F.current_timestamp())
        known.coalesce(1).write.mode("overwrite").parquet(f"{sink}/datasets/batch={batch_id}")
        refused = session.createDataFrame(sorted(problems.items()), "file string, reason string")
        refused.coalesce(1).write.mode("overwrite").parquet(f"{sink}/rejected/batch={batch_id}")

    reader = spark.readStream.format("binaryFile").schema(LISTED).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    stream = reader.option("maxFilesPerTrigger", GROUPS * files_per_batch).load(folder).select("path", "length")
    return stream.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
