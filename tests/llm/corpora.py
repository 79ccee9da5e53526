"""Small tables for the tests: nulls, empty, blank and long texts, copies, ties, clashing names."""

import random

from pyspark.sql import types as T

KINDS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("lang", T.StringType()),
        # names that operators use or return
        T.StructField("n_words", T.StringType()),
        T.StructField("_id", T.IntegerType()),
        T.StructField("kept", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("dotted.name", T.StringType()),
    ]
)


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def texts() -> list[tuple]:
    """(id, text) with distinct ids."""
    passage = words(1, 60)
    base = words(2, 300)
    near = base.split(" ")
    near[100] = "changed"
    far = near[:200] + words(3, 100).split(" ")
    out = [
        None, "", "   \t\n ", "one", "Four words are here", "a line that repeats\nand another", "A LINE that repeats  \nshort\n\nend of it all",
        "\n\n\n", passage, f"{words(4, 40)} {passage} {words(5, 40)}", f"{words(6, 40)}\n{passage} x {words(7, 40)}", base, base, base.upper(),
        " ".join(near), " ".join(far), words(8, 20) + " " + " ".join(["again and again"] * 40), "straße ÄÖÜ ñandú 日本語 текст <|endoftext|> emoji 🙂 end",
        words(9, 6000, 5000), f"{passage}\n{passage}", "x" * 5000, "tab\tseparated\x0bvertical\x0cfeed\rreturn " * 10, words(10, 34), words(11, 35), words(11, 35),
        "#### $$$$ %%%% " * 30, "Same line in here\n" * 6 + "Other line in here",
    ]
    return list(enumerate(out))


def rows(extra: bool = False) -> list[tuple]:
    out = [(i, t, f"s{i % 4}" if i % 5 else None, "en" if i % 3 else None, "clash", 7, None, "big", "d") for i, t in texts()]
    if extra:  # a row without an id, and repeated rows
        out += [(None, words(2, 300), None, None, "clash", 7, None, "big", "d"), out[9], out[9], out[5]]
    return out


def documents(spark, extra: bool = False, parts: int = 3):
    return spark.createDataFrame(rows(extra), KINDS).repartition(parts)


def no_documents(spark):
    return spark.createDataFrame([], KINDS)
