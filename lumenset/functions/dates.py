"""Date formats and date parsing as Column expressions."""

from functools import reduce

from pyspark.sql import Column, SparkSession, functions as F

# The date formats tried on a sample, in this order, as Spark patterns.
DATE_FORMATS = [
    "yyyy-M-d",
    "M/d/yyyy",
    "d/M/yyyy",
    "yyyy/M/d",
    "MMM d, yyyy",
    "d MMM yyyy",
    "MMMM d, yyyy",
    "d MMMM yyyy",
    "M-d-yyyy",
    "d-M-yyyy",
    "yyyy.M.d",
    "d.M.yyyy",
]

# Patterns tried when none of the above fits the sample (date with time, compact forms).
TIMED_FORMATS = [
    "yyyy-M-d H:m:s[.SSSSSS][.SSS]",
    "yyyy-M-d'T'H:m:s[.SSSSSS][.SSS]",
    "yyyy-M-d H:m",
    "M/d/yyyy H:m[:s]",
]
COMPACT_FORMATS = ["d-MMM-yyyy", "yyyyMMdd", "yyyy-M"]

# What a value looks like, and the first pattern above that can match such a value.
MONTH, NUMBER, CLOCK = r"(0?[1-9]|1[0-2])", r"\d{1,2}", r"\d{1,2}:\d{1,2}"
SECONDS, ZONE = r":\d{1,2}(\.\d{3}|\.\d{6})?", r"(Z|[+-]\d\d:?\d\d)"
SHAPES = [
    (rf"\d{{4}}-{NUMBER}-{NUMBER}", "yyyy-M-d"),
    (rf"{MONTH}/{NUMBER}/\d{{4}}", "M/d/yyyy"),
    (rf"{NUMBER}/{NUMBER}/\d{{4}}", "d/M/yyyy"),
    (rf"\d{{4}}/{NUMBER}/{NUMBER}", "yyyy/M/d"),
    (rf"[A-Za-z]{{3}} {NUMBER}, \d{{4}}", "MMM d, yyyy"),
    (rf"{NUMBER} [A-Za-z]{{3}} \d{{4}}", "d MMM yyyy"),
    (rf"[A-Za-z]{{4,}} {NUMBER}, \d{{4}}", "MMMM d, yyyy"),
    (rf"{NUMBER} [A-Za-z]{{4,}} \d{{4}}", "d MMMM yyyy"),
    (rf"{MONTH}-{NUMBER}-\d{{4}}", "M-d-yyyy"),
    (rf"{NUMBER}-{NUMBER}-\d{{4}}", "d-M-yyyy"),
    (rf"\d{{4}}\.{NUMBER}\.{NUMBER}", "yyyy.M.d"),
    (rf"{NUMBER}\.{NUMBER}\.\d{{4}}", "d.M.yyyy"),
    (rf"\d{{4}}-{NUMBER}-{NUMBER} {CLOCK}{SECONDS}{ZONE}?", TIMED_FORMATS[0]),
    (rf"\d{{4}}-{NUMBER}-{NUMBER}T{CLOCK}{SECONDS}{ZONE}?", TIMED_FORMATS[1]),
    (rf"\d{{4}}-{NUMBER}-{NUMBER} {CLOCK}{ZONE}?", TIMED_FORMATS[2]),
    (rf"{NUMBER}/{NUMBER}/\d{{4}} {CLOCK}(:\d{{1,2}})?{ZONE}?", TIMED_FORMATS[3]),
    (rf"{NUMBER}-[A-Za-z]{{3}}-\d{{4}}", "d-MMM-yyyy"),
    (r"\d{8}", "yyyyMMdd"),
    (rf"\d{{4}}-{NUMBER}", "yyyy-M"),
]

# Marks a column whose sample fits no pattern: each value is then read by its own look.
ANY_FORMAT = "any"

# Longest text that any pattern can match; longer values are never dates.
MAX_DATE_LENGTH = 40

# Range of a 64-bit nanosecond timestamp; dates outside it count as unparsable.
EARLIEST, LATEST = "1677-09-22 00:00:00", "2262-04-11 00:00:00"


def _in_range(parsed: Column) -> Column:
    return F.when(parsed.between(F.lit(EARLIEST).cast("timestamp"), F.lit(LATEST).cast("timestamp")), parsed)


def _without_zone(value: Column) -> Column:
    """Wall-clock part of a date with time."""
    return F.regexp_replace(value, rf"(\d){ZONE}$", "$1")


def pattern_of(value: Column) -> Column:
    """The pattern a value looks like, null if none; every pattern has a year of four digits."""
    short = F.when((F.length(value) <= MAX_DATE_LENGTH) & value.rlike(r"\d{4}"), value)
    first, *rest = [(short.rlike(f"^{shape}$"), pattern) for shape, pattern in SHAPES]
    return reduce(lambda chain, b: chain.when(*b), rest, F.when(*first))


def parse_one(value: Column, pattern: str) -> Column:
    """Timestamp of ``value`` under one pattern, null where it does not match as a whole."""
    text = _without_zone(value) if pattern in TIMED_FORMATS else value
    return _in_range(F.try_to_timestamp(text, F.lit(pattern)))


def parse_by(value: Column, pattern: Column) -> Column:
    """Like :func:`parse_as` with the pattern taken from a column."""
    own = F.when(pattern == ANY_FORMAT, pattern_of(value)).otherwise(pattern)
    text = F.when(own.isin(TIMED_FORMATS), _without_zone(value)).otherwise(value)
    return _in_range(F.try_to_timestamp(text, own))


def parse_any(value: Column) -> Column:
    """Timestamp under the pattern that this value looks like."""
    return parse_by(value, F.lit(ANY_FORMAT))


def parse_as(value: Column, pattern: str) -> Column:
    return parse_any(value) if pattern == ANY_FORMAT else parse_one(value, pattern)


def detect_format(sample: Column) -> Column:
    """First pattern that the sample matches, :data:`ANY_FORMAT` if none does, null without a sample."""
    own = pattern_of(sample)
    return F.when(sample.isNotNull(), F.when(parse_any(sample).isNotNull(), own).otherwise(ANY_FORMAT))


def short_sample(value: Column) -> Column:
    """The value where it may be a date, empty text in place of anything longer."""
    return F.when(F.length(value) > MAX_DATE_LENGTH, "").otherwise(value)


def formats_of_samples(spark: SparkSession, samples: dict[str, str | None]) -> dict[str, str | None]:
    """:func:`detect_format` for one sample per column."""
    if not samples:
        return {}
    rows = spark.createDataFrame(list(samples.items()), "name string, sample string")
    return {r["name"]: r["format"] for r in rows.select("name", detect_format(F.col("sample")).alias("format")).collect()}


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
