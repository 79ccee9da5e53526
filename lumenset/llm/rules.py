"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditions.

Sequential covering in the manner of incremental reduced error pruning: a rule grows by the threshold that gains most on
one part of the labelled rows, is pruned on the other, and the rows it covers leave before the next rule grows. Rules are
conjunctions of thresholds on plain statistics, such as ``symbols_per_word > 0.31``; the list becomes one ordered
``CASE WHEN``. Statistics, labels and verdicts are DataFrame expressions only; the driver sees counts
of at most ``sample`` labelled rows, binned.
"""

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kinds import quoted
from .frames import stored

SPACE = r"[\x20\x09-\x0D]+"
SAMPLE = 20_000
CUTS = 24
MOST_RULES = 12
MOST_CONDITIONS = 4
LEAST_WORDS = 50
LEAST_PRECISION = 0.98
LEAST_UNSEEN = 0.95
LEAST_COVERED = 0.002

# Statistics on which rules may put thresholds, from the counts below.
RATIOS = {
    "word_length": lambda s: s["word_chars"] / F.greatest(s["n_words"], F.lit(1)),
    "symbols_per_word": lambda s: s["n_symbols"] / F.greatest(s["n_words"], F.lit(1)),
    "capitals_per_char": lambda s: s["n_capitals"] / F.greatest(s["word_chars"], F.lit(1)),
    "marks_per_word": lambda s: s["n_marks"] / F.greatest(s["n_words"], F.lit(1)),
    "repeated_lines": lambda s: s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
    "repeated_words": lambda s: s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1)),
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in three-word windows that occur twice or more; a window is compared by its words."""

    def covered(places: Column) -> Column:
        n = F.size(places)
        # a window adds its three words, less those that the next window also covers
        own = F.transform(places, lambda p, k: F.when(k + 1 < n, F.least(F.lit(3), F.get(places, k + 1) - p)).otherwise(3))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x).cast("long")

    def again(windows: Column) -> Column:
        same_before = lambda x, k: F.get(windows, k - 1)["w"].eqNullSafe(x["w"])
        same_after = lambda x, k: F.get(windows, k + 1)["w"].eqNullSafe(x["w"])
        twice = F.filter(windows, lambda x, k: same_before(x, k) | same_after(x, k))
        return let(F.sort_array(F.transform(twice, lambda x: x["p"])), covered)

    window = lambda p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda p: F.struct(window(p).alias("w"), p.alias("p")))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), again))


def _only(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _statistics(text: Column) -> Column:
    """The counts of a text as one struct; null is an empty text."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        words = F.array_remove(F.split(t, SPACE), "")
        by_word = let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        )
        by_line = let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
            ),
        )
        symbols = r"#*$%&|<>"
        return F.struct(
            by_word.alias("by_word"), by_line.alias("by_line"), _only(t, symbols).alias("n_symbols"),
            _only(t, "A-Z").alias("n_capitals"), _only(t, "!?").alias("n_marks"),
        )

    return of(F.coalesce(text, F.lit("")))


def with_statistics(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` and a struct ``name`` of the counts. The counts are a generated column, so that conditions on them
    are not computed a second time below."""
    counted = df.select("*", F.explode(F.array(_statistics(text))).alias("_counts"))
    c = F.col("_counts")
    flat = F.struct(
        c["by_word"]["n_words"].alias("n_words"), c["by_word"]["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
        c["by_line"]["n_dup_lines"].alias("n_dup_lines"), c["by_word"]["n_repeat_words"].alias("n_repeat_words"),
        c["by_line"]["n_lines"].alias("n_lines"), c["n_capitals"].alias("n_capitals"), c["n_marks"].alias("n_marks"),
    )
    return counted.withColumn(name, flat).drop("_counts")


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self, statistics: Column) -> Column:
        value = RATIOS[self.statistic](statistics)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self):
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that meets all conditions of one is rejected."""

    rules: tuple[tuple[Condition, ...], ...]

    def first_rule(self, statistics: Column) -> Column:
        """Number of the first rule that rejects, from 1; 0 if none does."""
        case = None
        for number, rule in enumerate(self.rules, 1):
            meets = F.lit(True)
            for condition in rule:
                meets = meets & condition.column(statistics)
            case = F.when(meets, number) if case is None else case.when(meets, number)
        return F.lit(0) if case is None else case.otherwise(0)

    def __str__(self):
        return "\n".join(f"reject if {' and '.join(map(str, rule))}" for rule in self.rules) or "keep all"


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


# Learning


def _cells(labelled: DataFrame) -> tuple[dict[str, list[float]], list]:
    """Cut points of every ratio, and how many good and bad rows of each half fall into each cell between them."""
    names = list(RATIOS)
    ranks = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
    by_class = labelled.groupBy("bad").agg(*[F.percentile(n, ranks).alias(n) for n in names]).collect()
    cuts = {}
    for n in names:
        values = sorted({v for row in by_class for v in (row[n] or []) if v is not None})
        cuts[n] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    bins = [F.aggregate(F.array(*[(F.col(n) > c).cast("int") for c in cuts[n]]), F.lit(0), lambda a, x: a + x) if cuts[n] else F.lit(0) for n in names]
    rows = labelled.groupBy(F.array(*bins).alias("cell"), "half", "bad").count().collect()
    return cuts, [(tuple(r["cell"]), r["half"], r["bad"], r["count"]) for r in rows]


def _meets(cell, rule) -> bool:
    return all(cell[i] > j if above else cell[i] <= j for i, above, j in rule)


def _counts(cells, rule, half=None) -> tuple[int, int]:
    bad = good = 0
    for cell, of, is_bad, n in cells:
        if (half is None or of == half) and _meets(cell, rule):
            bad, good = (bad + n, good) if is_bad else (bad, good + n)
    return bad, good


def _grow(cells, n_cuts) -> list[tuple[int, bool, int]]:
    """Add the condition of the greatest information gain until no good row of the growing half is covered."""
    rule, inside = [], [c for c in cells if c[1] == 0]
    while len(rule) < MOST_CONDITIONS:
        bad, good = _counts(inside, rule)
        if not good or not bad:
            break
        best, most = None, 0.0
        for i, n in enumerate(n_cuts):
            totals = [[0, 0] for _ in range(n + 1)]
            for cell, _, is_bad, count in inside:
                totals[cell[i]][0 if is_bad else 1] += count
            below = [0, 0]
            for j in range(n):
                below = [below[0] + totals[j][0], below[1] + totals[j][1]]
                for above, (p, q) in ((False, below), (True, (bad - below[0], good - below[1]))):
                    if p:
                        gain = p * (log2(p / (p + q)) - log2(bad / (bad + good)))
                        if gain > most + 1e-9:
                            best, most = (i, above, j), gain
        if best is None:
            break
        rule.append(best)
        inside = [c for c in inside if _meets(c[0], [best])]
    return rule


def _prune(cells, rule) -> list[tuple[int, bool, int]]:
    """Drop last conditions while that does not worsen (bad - good) / (bad + good) on the pruning half."""

    def worth(r):
        bad, good = _counts(cells, r, 1)
        return (bad - good) / (bad + good) if bad + good else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r), -len(r)), default=[])


def learn(labelled: DataFrame) -> DecisionList:
    """A decision list from rows with the ratios, ``bad`` (boolean) and ``half`` (0: rules grow on it, 1: they are pruned on it).

    A rule is accepted if it covers LEAST_COVERED of the pruning half, at a precision of LEAST_UNSEEN there and LEAST_PRECISION
    in all. The rows of one that is not are set aside and rules go on growing on the rest, up to MOST_RULES accepted or as many set aside. A
    region is rejected as long as at most 2 % of its labels, and 5 % of those of the pruning half, are wrongly good; one with more passes.
    Without bad or without good rows the list is empty.
    """
    cuts, cells = _cells(labelled)
    names, rules = list(RATIOS), []
    n_cuts = [len(cuts[n]) for n in names]
    in_all = sum(c[3] for c in cells if c[1] == 1)
    if len({c[2] for c in cells}) < 2:
        return DecisionList(())
    left, failed = cells, 0  # rows that no accepted rule covers, those set aside among them: a rule meets these as well
    while len(rules) < MOST_RULES and failed < MOST_RULES:
        rule = _prune(cells, _grow(cells, n_cuts))
        if not rule:
            break
        bad, good = _counts(left, rule)
        unseen, wrong = _counts(left, rule, 1)
        cells = [c for c in cells if not _meets(c[0], rule)]
        if unseen < max(1, LEAST_COVERED * in_all) or bad < LEAST_PRECISION * (bad + good) or unseen < LEAST_UNSEEN * (unseen + wrong):
            failed += 1
            continue
        rules.append(tuple(Condition(names[i], above, cuts[names[i]][j]) for i, above, j in rule))
        left = [c for c in left if not _meets(c[0], rule)]
    return DecisionList(tuple(rules))


def fit_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> DecisionList:
    """Learn from at most ``sample`` labelled documents, those of the smallest hashes of their id; label 0 is bad.

    Labels without an id or a value and documents without an id are left out; a document with several labels takes part with each.
    """
    known = labels.select(quoted(id_col).cast("long").alias("_of"), (quoted(label_col) == 0).alias("bad")).dropna()
    known = known.orderBy(F.xxhash64("_of"), "_of", "bad").limit(sample)
    texts = docs.select(quoted(id_col).cast("long").alias("_id"), quoted(text_col).cast("string").alias("_text"))
    # at most `sample` rows of 9 bytes
    joined = texts.join(F.broadcast(known), F.col("_id") == F.col("_of"))
    counted = with_statistics(joined, F.col("_text"), "_s")
    ratios = [make(F.col("_s")).cast("double").alias(name) for name, make in RATIOS.items()]
    half = (F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(3)) == 0).cast("int").alias("half")
    return learn(stored(counted.filter(~base_failed(F.col("_s"))).select("bad", half, *ratios), "labelled"))


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` with the counts, ``base_failed``, ``rule`` (the first that rejects, 0 if none) and ``kept``, which replace
    columns of those names.

    A document fails the base at fewer than 50 words, or if more than half of its words stand in repeated windows of three.
    Null, empty and blank texts have no words and fail. One narrow projection: nothing is shuffled, repeated rows
    and rows without an id are judged like others, an empty table gives none.
    """
    s = F.col("_s")
    more = {n: s[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    more |= {"base_failed": base_failed(s), "rule": rules.first_rule(s), "kept": ~base_failed(s) & (rules.first_rule(s) == 0)}
    rest = [c for c in docs.columns if c not in more]
    rows = docs.select(F.struct(*[quoted(c) for c in rest]).alias("_row"), quoted(text_col).cast("string").alias("_text"))
    judged = with_statistics(rows, F.col("_text"), "_s")
    return judged.select(*[F.col("_row").getField(c).alias(c) for c in rest], *[c.alias(n) for n, c in more.items()])


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, its columns only, that pass the base and the rules."""
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_doc"), quoted(text_col).cast("string").alias("_text"))
    judged = with_statistics(rows, F.col("_text"), "_s")
    good = judged.filter(~base_failed(F.col("_s")) & (rules.first_rule(F.col("_s")) == 0))
    return good.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
