"""The whole cleaner as fit and transform.

Which columns the result has depends on the data, so ``fit_clean`` runs a few aggregate jobs that
bring back one small row each, and ``CleanModel.transform`` is one narrow, lazy projection.
"""

from dataclasses import dataclass, replace
from math import ceil, floor

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import formats_of_samples, iso_date, parse_as, short_sample
from ..functions.kinds import BOOL, NUMERIC, OTHER, ROW_ID, STRING, kind_of, number, present, quoted
from ..session import with_row_order
from .datecols import passes
from .impute import filled, fit_modes
from .outliers import QUARTILES, Bounds, bounds_of, is_outlier
from .quantiles import aggregate_row, interpolate, values_at_ranks


@dataclass(frozen=True)
class ColumnPlan:
    """What the cleaner does to one column."""

    name: str
    kind: str
    had_nulls: bool = False
    fill: float | str | None = None
    bounds: Bounds = None
    date_format: str | None = None


@dataclass(frozen=True)
class CleanModel:
    """Fitted cleaner; holds a few scalars per column."""

    n_rows: int
    columns: tuple[ColumnPlan, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        values = {p.name: _imputed(df, p) for p in self.columns}
        derived: dict[str, Column] = {}
        for p in self.columns:
            if p.kind == NUMERIC:
                derived[p.name + "_outlier"] = is_outlier(values[p.name].cast("double"), p.bounds)
        for p in self.columns:
            if p.date_format is None:
                continue
            # a column derived by an earlier cleaning is derived again from its source
            again = p.name.removesuffix("_date")
            if p.name.endswith("_date") and again + "_date" in derived:
                derived[p.name + "_date"] = derived[p.name]
            else:
                derived[p.name + "_date"] = iso_date(parse_as(values[p.name], p.date_format))
        values.update(derived)
        return df.select([v.alias(n) for n, v in values.items()])


def _imputed(df: DataFrame, plan: ColumnPlan) -> Column:
    """The column without gaps. One that had none when the model was fitted keeps its type."""
    if plan.kind not in (NUMERIC, STRING, BOOL):
        return quoted(plan.name)
    if plan.had_nulls:
        return filled(df, plan.name, plan.fill)
    kind = df.schema[plan.name].dataType
    if plan.kind == NUMERIC:
        fill = F.lit(plan.fill).cast("double")
        return F.coalesce(present(df, plan.name), (F.round(fill) if isinstance(kind, T.IntegralType) else fill).cast(kind))
    if plan.fill is not None:
        return F.coalesce(quoted(plan.name), F.lit(plan.fill).cast(kind))
    problem = f"column {plan.name} has gaps, but had none in the table that the model was fitted on; fit it with reusable=True"
    return F.coalesce(quoted(plan.name), F.raise_error(F.lit(problem)).cast(kind))


def fit_clean(df: DataFrame, order_by: str | list[str] | None = None, reusable: bool = False, **limits) -> CleanModel:
    """Fit on the whole table. ``order_by`` gives the row order that date samples follow.

    The model fills gaps of numbers in any later table. With ``reusable`` it also knows the modes of text columns that have
    no gaps here; without, a later gap in such a column is an error when the rows are read. ``approx=True`` takes
    medians and quartiles from one bounded sketch, ``direct_rows`` is described in quantiles.
    """
    kinds = {f.name: kind_of(f.dataType) if f.name != ROW_ID else OTHER for f in df.schema.fields}
    numbers = [c for c, k in kinds.items() if k == NUMERIC]
    texts = [c for c, k in kinds.items() if k == STRING]
    flags = [c for c, k in kinds.items() if k == BOOL]
    ordered, order = with_row_order(df, order_by)

    # 1. sizes, and the first row's text per column
    measured = numbers + texts + flags
    first = {c: F.min_by(short_sample(quoted(c)), order) for c in texts}
    row = aggregate_row(
        ordered,
        [F.count(F.lit(1))]
        + [F.count(number(df, c) if c in numbers else quoted(c)) for c in measured]
        + [first[c] for c in texts],
    )
    n_rows = row[0]
    nulls = {c: n_rows - n for c, n in zip(measured, row[1:])}
    samples = dict(zip(texts, row[1 + len(measured) :]))

    return _fit_columns(df, n_rows, kinds, nulls, samples, reusable, limits)


def _fit_columns(df: DataFrame, n_rows: int, kinds: dict, nulls: dict, samples: dict, reusable: bool, limits: dict) -> CleanModel:
    numbers, texts = ([c for c, k in kinds.items() if k == kind] for kind in (NUMERIC, STRING))

    # 2. fill values of text, only for columns with gaps unless the model is for later tables
    filled_texts = [c for c, k in kinds.items() if k in (STRING, BOOL) and (nulls[c] or reusable)]
    fills: dict[str, float | str | None] = dict(fit_modes(df, filled_texts))
    fills.update({c: None for c, k in kinds.items() if k == BOOL and nulls[c] == n_rows})
    # where the first row was null, the sample is what fills it
    samples = {c: fills[c] if s is None and n_rows else s for c, s in samples.items()}
    formats = formats_of_samples(df.sparkSession, samples)
    plans = {c: ColumnPlan(c, k, bool(nulls.get(c)), fills.get(c)) for c, k in kinds.items()}

    # 3. medians, quartiles of the filled numbers, and the share of parsable dates
    dated = [c for c in texts if formats[c]]
    parsable = [parse_as(_imputed(df, plans[c]), formats[c]).isNotNull() for c in dated]
    known = {c: n_rows - nulls[c] for c in numbers}
    ranks = {c: _ranks(known[c], nulls[c]) for c in numbers}
    found, shares = values_at_ranks(df, {c: number(df, c) for c in numbers}, ranks, known, parsable, **limits)
    kept = {c for c, share in zip(dated, shares) if passes(share)}
    for c, values in found.items():
        median, quartiles = _median_and_quartiles(known[c], nulls[c], values)
        plans[c] = replace(plans[c], fill=median, bounds=bounds_of(*quartiles))
    for c in kept:
        plans[c] = replace(plans[c], date_format=formats[c])
    return CleanModel(n_rows, tuple(plans.values()))


def _source_rank(k: int, present: int, gaps: int) -> int | None:
    """Rank among the present values of the k-th value after filling, None for a filled one.

    The filled rows, all equal to the median, sort right behind the lower middle value.
    """
    middle = (present - 1) // 2
    return k if k <= middle else None if k <= middle + gaps else k - gaps


def _ranks(present: int, gaps: int) -> list[int]:
    places = [p * (present + gaps - 1) for p in QUARTILES]
    wanted = [_source_rank(k, present, gaps) for at in places for k in (floor(at), ceil(at))]
    return [(present - 1) // 2, present // 2] + [r for r in wanted if r is not None]


def _median_and_quartiles(present: int, gaps: int, values: dict[int, float]) -> tuple[float, list[float]]:
    median = interpolate((present - 1) * 0.5, values)
    quartiles = []
    for at in [p * (present + gaps - 1) for p in QUARTILES]:
        ranks = {k: _source_rank(k, present, gaps) for k in (floor(at), ceil(at))}
        quartiles.append(interpolate(at, {k: median if r is None else values[r] for k, r in ranks.items()}))
    return median, quartiles


def clean(df: DataFrame, order_by: str | list[str] | None = None) -> DataFrame:
    """Impute, flag outliers and add dates; the number of rows never changes."""
    return fit_clean(df, order_by).transform(df)
