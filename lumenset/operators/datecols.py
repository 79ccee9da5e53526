"""Find text columns that hold dates and add them as ISO dates."""

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import formats_of_samples, iso_date, parse_as, short_sample
from ..functions.kinds import STRING, columns_of, quoted
from ..session import with_row_order
from .quantiles import aggregate_row


def fit_formats(df: DataFrame, columns: list[str], order_by=None) -> dict[str, str | None]:
    """Pattern per column, from its first non-null value in row order."""
    df, order = with_row_order(df, order_by)
    firsts = [F.min_by(short_sample(quoted(c)), F.when(quoted(c).isNotNull(), order)) for c in columns]
    samples = dict(zip(columns, aggregate_row(df, firsts))) if columns else {}
    return formats_of_samples(df.sparkSession, samples)


def detect_date_format(df: DataFrame, columns: list[str] | None = None, order_by=None) -> DataFrame:
    """(column, format), one row per text column; ``any`` where no single pattern fits."""
    columns = columns_of(df, STRING) if columns is None else columns
    rows = list(fit_formats(df, columns, order_by).items())
    return df.sparkSession.createDataFrame(rows, "column string, format string")


def parse_dates(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Add ``<column>_date`` as ISO text under the given pattern; failures become null."""
    derived = {c + "_date": iso_date(parse_as(quoted(c), f)) for c, f in formats.items()}
    kept = [quoted(c) for c in df.columns if c not in derived]
    return df.select(*kept, *[v.alias(n) for n, v in derived.items()])


def valid_shares(df: DataFrame, formats: dict[str, str]) -> dict[str, float | None]:
    shares = [F.avg(parse_as(quoted(c), f).isNotNull().cast("int")) for c, f in formats.items()]
    return dict(zip(formats, aggregate_row(df, shares))) if shares else {}


def passes(share: float | None) -> bool:
    """Dates are kept if more than half of all rows parse; exactly half is not enough."""
    return share is not None and share > 0.5


def date_gate(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """:func:`parse_dates` for the columns that hold mostly dates, the others left alone."""
    shares = valid_shares(df, formats)
    return parse_dates(df, {c: f for c, f in formats.items() if passes(shares[c])})
