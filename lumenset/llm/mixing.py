"""Mixing sources to target weights by entropy balancing.

Document rates are the ones nearest to 1 in relative entropy that give every source its target number of words:
minimise sum(r log r - r + 1) with sum(size * r) = target and r <= cap. The dual is convex with one
multiplier per source, and its solution tilts a document exponentially in its words:
r = min(cap, exp(multiplier * size / mean size)). Newton steps, kept inside a bracket, run as aggregates over
the histogram of (source, size); all sources step at once.

Rates become copies by sequential Poisson rounding: a document has floor(r) copies, and those of smallest
hash / fraction get one more until the words of their source are met, large documents first, so that the small ones make
up for what the large ones miss.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kinds import quoted
from .frames import stored, with_rank

BINS = 4096
STEPS = 60


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weight: Column, cap: int, many: int) -> DataFrame:
    """``sources`` (``many`` rows; ``source_size``) with ``target``: shares of all sizes by weight, none above ``cap`` times its size.

    What a source can't take is shared again by weight among the others until none is above.
    """
    rows = stored(sources.withColumn("_weight", weight.cast("double")).withColumn("_most", F.col("source_size") * cap), "weights", many)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # target of weight 1
    while True:
        full = F.col("_weight") * level > F.col("_most") if level else F.lit(False)
        taken, open_weight, n_full = rows.agg(
            F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("_weight"))), F.count(F.when(full, 1))
        ).first()
        after = (total - (taken or 0)) / open_weight if open_weight else 0.0
        if after <= level or not open_weight:
            break
        level = after
    target = F.least(F.col("_weight") * F.lit(level), F.col("_most").cast("double"))
    return rows.withColumn("target", target).drop("_weight", "_most")


def solve_rates(histogram: DataFrame, sources: DataFrame, cap: int, many: int) -> DataFrame:
    """``src``, ``multiplier`` and ``scale`` of every source: Newton on the dual, all sources in each aggregate.

    ``histogram``: ``src``, ``size``, ``n``; ``sources`` (``many`` rows): ``src``, ``target``, ``source_size``. A source whose target
    is all it can give has a null multiplier and the rate ``cap``; one without words or target has rate 0 and the
    multiplier minus infinity.
    """
    words = histogram.filter("size > 0").groupBy("src").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.min("size").alias("least")
    )
    state = sources.join(words, "src").filter(F.col("target") < F.col("source_size") * cap).filter("target > 0")
    state = stored(
        state.select(
            "src", "target", "scale", (F.log(F.lit(float(cap))) * F.col("scale") / F.col("least")).alias("hi"),
            F.lit(-1.0e3).alias("lo"), F.log(F.col("target") / F.col("source_size")).alias("multiplier"), F.lit(False).alias("done"),
        ),
        "duals", many,
    )
    exponent = F.col("multiplier") * F.col("size") / F.col("scale")
    rate = F.exp(F.least(exponent, F.log(F.lit(float(cap)))))
    mass = F.col("n") * F.col("size") * rate
    for _ in range(STEPS):
        sums = histogram.join(state.filter("not done").select("src", "multiplier", "scale"), "src").groupBy("src").agg(
            exact_sum(mass).alias("given"), exact_sum(F.when(exponent < F.log(F.lit(float(cap))), mass * F.col("size") / F.col("scale"))).alias("slope")
        )
        gap = F.col("given") - F.col("target")
        lo = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("hi"))
        newton = F.col("multiplier") - gap / F.col("slope")
        stepped = F.when(F.col("slope").isNotNull() & (newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        near = F.abs(gap) <= F.greatest(F.lit(0.25), F.col("target") * 1e-9)
        close = F.col("done") | F.coalesce(near, F.lit(True)) | (hi - lo < 1e-12)
        keep = F.col("done") | F.coalesce(near, F.lit(True))
        state = stored(
            state.join(sums, "src", "left").select(
                "src", "target", "scale",
                F.when(keep, F.col("hi")).otherwise(hi).alias("hi"), F.when(keep, F.col("lo")).otherwise(lo).alias("lo"),
                F.when(keep, F.col("multiplier")).otherwise(stepped).alias("multiplier"), close.alias("done"),
            ),
            "duals", many,
        )
        if state.filter("not done").isEmpty():
            break
    given = F.when(F.col("target") > 0, F.col("multiplier")).otherwise(F.lit(float("-inf")))
    return sources.select("src", "target").join(state.select("src", "multiplier", "scale"), "src", "left").select("src", given.alias("multiplier"), "scale")


def exact_sum(value: Column) -> Column:
    """Sum of doubles rounded to nine places: the same in whatever order tasks end."""
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def document_rates(rows: DataFrame, cap: int) -> DataFrame:
    """``rate`` of rows with ``size``, ``multiplier`` and ``scale``. Documents without words are taken once."""
    tilt = F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("scale"), F.log(F.lit(float(cap)))))
    tilted = F.when(F.col("multiplier").isNull(), F.lit(float(cap))).when(F.col("multiplier") == float("-inf"), F.lit(0.0)).otherwise(tilt)
    return rows.withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(tilted))


def _priority(seed: int) -> Column:
    """A number in (0, 1) from the document alone, over its fraction: the order in which documents get a further copy."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id", "src", "size"), 11) + 0.5) / float(1 << 53)
    return uniform / (F.col("rate") - F.floor("rate"))


def _size_class() -> Column:
    return F.length(F.bin("size"))


def _has_fraction() -> Column:
    return (F.col("rate") > F.floor("rate")) & (F.col("size") > 0)


def round_rates(rated: DataFrame) -> DataFrame:
    """``src``, ``class`` and ``threshold``: documents of a priority below it get one copy more than floor(rate).

    ``rated``: ``src``, ``size``, ``rate`` and ``priority``. Sizes form classes by their power of two. From the largest class
    down, each takes the documents of least priority until its share of words is met as nearly as can be; what is missing or too
    much goes over to the next class, whose documents are smaller. One aggregate of at most BINS sums by class feeds this.
    """
    bin_ = F.floor(F.least(F.col("priority") * (BINS // 4), F.lit(BINS)))
    share = (F.col("rate") - F.floor("rate")) * F.col("size")
    sums = rated.filter(_has_fraction()).groupBy("src", _size_class().alias("class"), bin_.alias("bin"))
    sums = sums.agg(F.sum("size").alias("words"), exact_sum(share).alias("share"))

    def choose(table: pd.DataFrame) -> pd.DataFrame:
        rows, owed = [], 0.0
        for size_class, part in sorted(table.groupby("class"), reverse=True):
            part = part.sort_values("bin")
            owed += part["share"].sum()
            upto = np.concatenate([[0], part["words"].cumsum()])
            best = int(np.abs(upto - owed).argmin())
            owed -= float(upto[best])
            last = part["bin"].iloc[best - 1] if best else -1
            rows.append((table["src"].iloc[0], size_class, np.inf if last == BINS else (last + 1) / (BINS // 4)))
        return pd.DataFrame(rows, columns=["src", "class", "threshold"])

    return sums.groupBy("src").applyInPandas(choose, "src long, class int, threshold double")


def document_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = 3, seed: int = 17,
) -> DataFrame:
    """The columns of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, which replace columns of those names.

    Size: words of the text. Sources in code point order, null last, weigh ``weights`` in turn and share as many words as
    there are; targets stop at ``cap`` times the source's size. Every document is taken ``copies`` times, 0 to ``cap``.

    A null or blank text has no words and is taken once. Null is a source like others. Rows without an id and repeated rows
    are mixed like others; equal rows get equal copies. If no text has words all targets are 0. An empty table gives none.
    Copies depend on the rows and the seed only.
    """
    base = docs.select(quoted(id_col).cast("long").alias("_id"), quoted(source_col).alias("_source"), n_words(quoted(text_col)).alias("size"))
    base = stored(base, "sizes")
    sources = base.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("_source").isNull().cast("int"))
    sources, many = with_rank(sources, ["_last", "_source"], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    sources = stored(water_fill(sources.withColumnRenamed("_rank", "src").drop("_last"), weight, cap, many), "targets", many)
    named = base.join(sources.select("_source", "src"), base["_source"].eqNullSafe(sources["_source"])).drop("_source")
    histogram = stored(named.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "histogram", base.count())
    rates = stored(solve_rates(histogram, sources, cap, many), "rates", many)
    rated = document_rates(named.join(rates, "src"), cap).withColumn("priority", _priority(seed))
    cuts = stored(round_rates(rated), "thresholds", 64 * many).withColumnsRenamed({"src": "_src", "class": "_class"})
    facts = stored(sources.join(rates, "src").withColumnRenamed("_source", "_of"), "mix", many)
    more = {"size", "source_size", "target", "copies"}
    rest = [c for c in docs.columns if c not in more]
    rows = docs.select(
        F.struct(*[quoted(c) for c in rest]).alias("_row"), quoted(id_col).cast("long").alias("_id"),
        quoted(source_col).alias("_source"), n_words(quoted(text_col)).alias("size"),
    )
    rows = document_rates(rows.join(facts, F.col("_source").eqNullSafe(F.col("_of"))), cap)
    rows = rows.join(cuts, (F.col("src") == F.col("_src")) & (_size_class() == F.col("_class")), "left")
    copies = F.floor("rate") + F.coalesce(_has_fraction() & (_priority(seed) < F.col("threshold")), F.lit(False)).cast("long")
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in rest], "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken (see document_copies); its columns only."""
    taken = document_copies(docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_doc"), *[quoted(c) for c in dict.fromkeys((id_col, text_col, source_col))]), id_col, text_col, source_col, **options)
    repeated = taken.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
