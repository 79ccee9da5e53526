"""Exact quantiles of many columns without moving the data.

A bounded sketch proposes two edges around every wanted rank, a counting pass tells on which side the
rank lies, and this repeats until at most ``direct_rows`` values lie between the edges, which one exact
aggregate then orders. A column of no more values needs no round at all. Only aggregates of
bounded size are shuffled, whatever the number of rows: a scan for the counts, two for the first round
and one to pick, up to about 10^7 rows; two more for every further factor of 2500.
"""

from dataclasses import dataclass
from math import ceil, floor, inf, nextafter

from pyspark.sql import Column, DataFrame, Row, functions as F

# Values that an exact aggregate holds in one task.
DIRECT_ROWS = 20_000
SKETCH_ACCURACY = 10_000
MARGIN = 2 / SKETCH_ACCURACY


@dataclass
class _Bracket:
    """Closed interval of a column known to hold the value at ``rank`` (0-based)."""

    column: str
    rank: int
    inside: int
    low: float = -inf
    high: float = inf
    below: int = 0

    @property
    def span(self) -> tuple:
        return self.column, self.low, self.high

    @property
    def within(self) -> Column:
        value = F.col(self.column)
        return value if self.low == -inf and self.high == inf else F.when(value.between(self.low, self.high), value)

    @property
    def ends(self) -> list[float]:
        """Where in the interval to look for edges."""
        at = (self.rank - self.below) / self.inside
        return [max(0.0, at - MARGIN), min(1.0, at + MARGIN)]

    def settled(self, limit: int) -> bool:
        return self.low == self.high or self.inside <= limit


def aggregate_row(df: DataFrame, aggregates: list[Column]) -> Row:
    """One row of aggregates: metadata, one value per aggregate."""
    return df.agg(*aggregates).first()


def values_at_ranks(
    df: DataFrame,
    values: dict[str, Column],
    ranks: dict[str, list[int]],
    counts: dict[str, int],
    conditions: list[Column] | None = None,
    direct_rows: int = DIRECT_ROWS,
    approx: bool = False,
) -> tuple[dict[str, dict[int, float]], list[float | None]]:
    """The values at the given ranks (0-based, nulls left out) of each column.

    ``counts`` are the present values per column; they decide, before any values are gathered,
    whether rounds are needed first. Also returns the share of rows that meet each condition, from
    the first scan. With ``approx`` the values come from one bounded sketch, whose ranks are off by one in SKETCH_ACCURACY at most.
    """
    conditions = conditions or []
    wanted = {n: sorted(set(ranks[n])) for n in values if counts[n]}
    if not wanted and not conditions:
        return {}, []
    keys = {name: f"v{i}" for i, name in enumerate(wanted)}
    flags = [f"c{i}" for i in range(len(conditions))]
    narrow = df.select(
        *[values[n].alias(k) for n, k in keys.items()],
        *[F.coalesce(c, F.lit(False)).cast("int").alias(f) for c, f in zip(conditions, flags)],
    )
    shares = [F.avg(f) for f in flags]
    if approx:
        sketches = [F.percentile_approx(keys[n], [r / max(counts[n] - 1, 1) for r in wanted[n]], SKETCH_ACCURACY) for n in wanted]
        row = aggregate_row(narrow, sketches + shares)
        return {n: dict(zip(wanted[n], row[i])) for i, n in enumerate(wanted)}, list(row[len(sketches) :])
    largest = max((counts[n] for n in wanted), default=0)
    if largest <= direct_rows:
        picks = [_pick(keys[n], wanted[n], counts[n]) for n in wanted]
        row = aggregate_row(narrow, picks + shares)
        return {n: dict(zip(wanted[n], row[i])) for i, n in enumerate(wanted)}, list(row[len(picks) :])

    brackets = [_Bracket(keys[n], rank, counts[n]) for n in wanted for rank in wanted[n]]
    # the shares come along with the first sketch
    edges, found_shares = _sketch(narrow, brackets, shares)
    _settle(narrow, brackets, edges, direct_rows)
    picked = iter(_ordered_values(narrow, brackets))
    return {n: {rank: next(picked) for rank in wanted[n]} for n in wanted}, found_shares


def _pick(column: str, ranks: list[int], count: int) -> Column:
    """Array of the values at the ranks, from one exact aggregate where the ranks can be hit exactly."""
    hits = [_share_of_rank(rank, count) for rank in ranks]
    if None not in hits:
        return F.percentile(F.col(column), F.array(*[F.lit(h) for h in hits]))
    return F.array(*[_element(column, rank, count) for rank in ranks])


def _share_of_rank(rank: int, count: int) -> float | None:
    """A percentage whose position among ``count`` values is the rank itself, without rounding."""
    share = rank / max(count - 1, 1)
    for near in (share, nextafter(share, inf), nextafter(share, -inf)):
        if near * (count - 1) == rank and 0 <= near <= 1:
            return near
    return None


def _element(column: str, rank: int, count: int) -> Column:
    # the half keeps the wanted element unambiguous under floating-point division
    return F.expr(f"percentile_disc({(rank + 0.5) / count!r}D) within group (order by {column})")


def exact_quantiles(
    df: DataFrame, values: dict[str, Column], probabilities: list[float], direct_rows: int = DIRECT_ROWS, approx: bool = False
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each value, null for a column without values."""
    if not values:
        return {}
    counts = dict(zip(values, aggregate_row(df, [F.count(v) for v in values.values()])))
    places = {n: [p * (counts[n] - 1) for p in probabilities] for n in values}
    ranks = {n: [r for at in places[n] for r in (floor(at), ceil(at))] for n in values}
    found, _ = values_at_ranks(df, values, ranks, counts, direct_rows=direct_rows, approx=approx)
    return {n: [interpolate(at, found[n]) if counts[n] else None for at in places[n]] for n in values}


def interpolate(at: float, found: dict[int, float]) -> float:
    """Value at a fractional place between two ranks."""
    weight = at - floor(at)
    return found[floor(at)] if weight == 0 else (1 - weight) * found[floor(at)] + weight * found[ceil(at)]


def _settle(df: DataFrame, brackets: list[_Bracket], edges: list[tuple], limit: int) -> None:
    _narrow(df, brackets, edges)
    while wide := [b for b in brackets if not b.settled(limit)]:
        _narrow(df, wide, _sketch(df, wide)[0])


def _ordered_values(df: DataFrame, brackets: list[_Bracket]) -> list[float]:
    open_ = [b for b in brackets if b.low < b.high]
    found: dict[int, float] = {}
    if open_:
        few = df.select([b.within.alias(f"b{i}") for i, b in enumerate(open_)])
        row = aggregate_row(few, [_element(f"b{i}", b.rank - b.below, b.inside) for i, b in enumerate(open_)])
        found = {id(b): value for b, value in zip(open_, row)}
    return [found.get(id(b), b.low) for b in brackets]


def _sketch(df: DataFrame, brackets: list[_Bracket], extra: list[Column] | None = None) -> tuple[list[tuple], list]:
    """Two values of the column around every rank; brackets of one span share a sketch."""
    ends: dict[tuple, list[float]] = {}
    for b in brackets:
        ends.setdefault(b.span, []).extend(b.ends)
    spans = {b.span: b.within for b in brackets}
    sketches = [F.percentile_approx(spans[s], ends[s], SKETCH_ACCURACY) for s in spans]
    row = aggregate_row(df, sketches + (extra or []))
    found = {s: iter(values) for s, values in zip(spans, row)}
    return [(next(found[b.span]), next(found[b.span])) for b in brackets], list(row[len(sketches) :])


def _narrow(df: DataFrame, brackets: list[_Bracket], edges: list[tuple[float, float]]) -> None:
    """Count around the edges of every bracket and keep the piece with its rank.

    The edges are values of the column and form pieces of their own, so each pass shrinks the
    bracket even if one value fills most of it.
    """
    places = list(dict.fromkeys((b.column, e) for b, pair in zip(brackets, edges) for e in pair))
    counts = [c for column, e in places for c in (F.count_if(F.col(column) < e), F.count_if(F.col(column) <= e))]
    row = aggregate_row(df, counts)
    tally = {place: (row[2 * i], row[2 * i + 1]) for i, place in enumerate(places)}

    for b, (low, high) in zip(brackets, edges):
        before_low, upto_low = tally[b.column, low]
        before_high, upto_high = tally[b.column, high]
        end = b.below + b.inside
        if b.rank < before_low:
            b.high, b.inside = nextafter(low, -inf), before_low - b.below
        elif b.rank < upto_low:
            b.low = b.high = low
            b.below, b.inside = before_low, upto_low - before_low
        elif b.rank < before_high:
            b.low, b.high = nextafter(low, inf), nextafter(high, -inf)
            b.below, b.inside = upto_low, before_high - upto_low
        elif b.rank < upto_high:
            b.low = b.high = high
            b.below, b.inside = before_high, upto_high - before_high
        else:
            b.low, b.below, b.inside = nextafter(high, inf), upto_high, end - upto_high
