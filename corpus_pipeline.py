"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again
as the next one's documents. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenset.llm import lines, mixing, neardup, packing, rules
from lumenset.llm.frames import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or that a learned rule rejects go."""
    learned = rules.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rules.keep_good(docs, learned)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows the text.

    A document that this cuts below the least number of words of the quality rules goes as a whole: what is left of a copy are its
    few changed lines, no text. Documents that lose nothing stay as they are, null and empty texts included. Other columns
    are carried along whatever their names.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    kept = lines.drop_repeated_lines(rows)
    kept = kept.filter((F.col("n_dropped") == 0) | (mixing.n_words(F.col("text")) >= rules.LEAST_WORDS))
    chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), **chars}
    return kept.select(*[own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id."""
    return neardup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("source mix", mix_sources),
    ("packing", pack),
]

# Learned rules, tokens and hashed rounding are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
