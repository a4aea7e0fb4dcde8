"""Bin rules for number and date columns.

A rule is chosen on the driver from two numbers, the smallest and the largest
value, and becomes plain column arithmetic: a bigint bin index to group by and
the two edges, computed after grouping from the index alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

from tallyscope.functions.sqltext import double_literal, quote_name

STEPS = 18

# Bin index of NaN and the infinities. A finite value never gets it: the
# index is at most STEPS * 2**53 away from zero.
NONFINITE = -(2**63)
NONFINITE_SQL = f"(-{2**63 - 1}L - 1L)"

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
EPOCH_MONTH = 1970 * 12

_MILLI = 1_000
_SECOND = 1_000_000
_MINUTE = 60 * _SECOND
_HOUR = 60 * _MINUTE
_DAY = 24 * _HOUR
_MONTH = 30 * _DAY
_YEAR = 365 * _DAY


@dataclass(frozen=True)
class NumberBins:
    """Bin ``k`` is ``[origin + k * step, origin + (k + 1) * step)``."""

    step: float
    origin: float = 0.0

    def index_sql(self, name: str, dtype: T.DataType, exact: bool = False) -> str:
        """Bin index; ``exact`` makes it agree with ``x >= edge`` to the last bit."""
        x = f"CAST({quote_name(name)} AS DOUBLE)"
        step, origin = double_literal(self.step), double_literal(self.origin)
        from_origin = f"({x} - {origin})" if self.origin else x
        k = f"floor({from_origin} / {step})"
        if exact:
            k = (
                f"{k} - CAST({x} < {origin} + {k} * {step} AS INT)"
                f" + CAST({x} >= {origin} + ({k} + 1) * {step} AS INT)"
            )
        if not isinstance(dtype, (T.FloatType, T.DoubleType)):
            return k
        # NaN and the infinities are exactly the values with x - x <> 0.
        return f"CASE WHEN {x} - {x} = 0D THEN {k} WHEN {x} IS NOT NULL THEN {NONFINITE_SQL} END"

    def edge(self, k: int) -> float:
        return self.origin + k * self.step


@dataclass(frozen=True)
class DateBins:
    """Bins of a fixed number of microseconds, or of whole months, from the epoch."""

    micros: int = 0
    months: int = 0

    def index_sql(self, name: str, dtype: T.DataType, exact: bool = False) -> str:
        if self.months:
            at, width = _month_sql(quote_name(name), dtype), self.months
        else:
            at, width = micros_sql(quote_name(name), dtype), self.micros
        return f"(({at} - pmod({at}, {width}L)) div {width}L)"


def micros_sql(value: str, dtype: T.DataType) -> str:
    """Microseconds since the epoch in UTC, whatever the session time zone."""
    if isinstance(dtype, T.DateType):
        return f"(unix_date({value}) * {_DAY}L)"
    if isinstance(dtype, T.TimestampType):
        return f"unix_micros({value})"
    return f"timestampdiff(MICROSECOND, {EPOCH}, {value})"


def _month_sql(value: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.TimestampType):
        value = f"timestampadd(MICROSECOND, unix_micros({value}), {EPOCH})"
    return f"CAST(year({value}) * 12 + month({value}) - 1 AS BIGINT)"


def number_bins(lo: float | None, hi: float | None, steps: int = STEPS) -> NumberBins:
    """Choose the 1-2-5 step that gives at most about ``steps`` bins."""
    if lo is None or hi is None:
        return NumberBins(1.0)
    span = hi - lo
    if span == 0:
        return NumberBins(1.0, lo)
    if math.isinf(span):
        return NumberBins(2e307)
    power = 10.0 ** (math.floor(math.log10(span) + 0.5) - 1)
    if power == 0:
        return NumberBins(span)
    if math.ceil(span / power) > steps:
        power *= 10.0
    fifth = power / 5.0 if span / (power / 5.0) <= steps else power
    return NumberBins(fifth / 2.0 if span / (fifth / 2.0) <= steps else fifth)


def _date_candidates(span: int) -> list[tuple[int, DateBins]]:
    # Step sizes per calendar unit.
    milliseconds = [1, 2, 5, 10, 20, 50, 100, 200, 500]
    seconds = [1, 5, 15, 30]
    minutes = [1, 5, 15, 30]
    hours = [1, 3, 6, 12]
    days = [1, 2, 7]
    months = [1, 3]
    out = []
    units = (milliseconds, _MILLI), (seconds, _SECOND), (minutes, _MINUTE), (hours, _HOUR), (days, _DAY)
    for sizes, unit in units:
        out += [(n * unit, DateBins(micros=n * unit)) for n in sizes]
    out += [(n * _MONTH, DateBins(months=n)) for n in months]
    years = 1
    while True:
        for n in (years, 2 * years, 5 * years):
            out.append((n * _YEAR, DateBins(months=12 * n)))
        if years * _YEAR > span:
            return out
        years *= 10


def date_bins(lo: int | None, hi: int | None, steps: int = STEPS) -> DateBins:
    """Choose the calendar step nearest, as a ratio, to ``span / steps``."""
    if lo is None or hi is None or lo == hi:
        return DateBins(micros=_MILLI)
    target = (hi - lo) / steps
    candidates = _date_candidates(hi - lo)
    return min(candidates, key=lambda c: max(c[0] / target, target / c[0]))[1]


def number_edge_sql(k: str, step: str, origin: str) -> str:
    """Start of number bin ``k``; NULL for the bin of NaN and the infinities."""
    return f"CASE WHEN k <> {NONFINITE_SQL} THEN {origin} + {k} * {step} END"


def date_edge_sql(k: str, micros: str, months: str) -> str:
    """Start of date bin ``k``; exactly one of ``micros`` and ``months`` is not 0."""
    return (
        f"CASE WHEN {months} > 0 "
        f"THEN timestampadd(MONTH, CAST({k} * {months} - {EPOCH_MONTH}L AS INT), {EPOCH}) "
        f"ELSE timestampadd(MICROSECOND, {k} * {micros}, {EPOCH}) END"
    )
