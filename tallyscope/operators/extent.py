"""Smallest and largest value per histogram column, in one scan."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyscope.functions import bins
from tallyscope.functions.columns import CATEGORY, DATE, NUMBER, field, role, type_name
from tallyscope.functions.sqltext import quote_name, string_literal


@dataclass(frozen=True)
class Extent:
    """Finite extent of one column: doubles, or UTC microseconds for dates."""

    lo: float | int | None
    hi: float | int | None

    def bins(self, column_role: str, steps: int = bins.STEPS):
        choose = bins.date_bins if column_role == DATE else bins.number_bins
        return choose(self.lo, self.hi, steps)


def _finite_sql(name: str, dtype: T.DataType) -> str:
    """The value, with NaN and the infinities made NULL."""
    x = quote_name(name)
    return f"CASE WHEN {x} - {x} = 0 THEN {x} END" if _has_nonfinite(dtype) else x


def _has_nonfinite(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _measure_sql(value: str, dtype: T.DataType) -> str:
    """A value on the scale of an extent."""
    return bins.micros_sql(value, dtype) if role(dtype) == DATE else f"CAST({value} AS DOUBLE)"


def histogram_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if role(f.dataType) != CATEGORY]


def extents(df: DataFrame, columns: list[str]) -> dict[str, Extent]:
    """Collect the extents: one aggregate, one row, two numbers per column.

    The aggregates are over bare columns, which is the form a source can answer
    from its own statistics. Only columns that turn out to hold NaN or an
    infinity are measured once more without them.
    """
    found = _extents(df, columns, finite=False)
    odd = [
        c for c, e in found.items() if e.lo is not None and not (isfinite(e.lo) and isfinite(e.hi))
    ]
    return {**found, **_extents(df, odd, finite=True)}


def _extents(df: DataFrame, columns: list[str], finite: bool) -> dict[str, Extent]:
    if not columns:
        return {}
    asked = []
    for i, name in enumerate(columns):
        dtype = field(df.schema, name).dataType
        value = _finite_sql(name, dtype) if finite else quote_name(name)
        asked += [
            f"{_measure_sql(f'min({value})', dtype)} AS lo{i}",
            f"{_measure_sql(f'max({value})', dtype)} AS hi{i}",
        ]
    row = df.selectExpr(*asked).head()
    return {name: Extent(row[2 * i], row[2 * i + 1]) for i, name in enumerate(columns)}


def column_overview(df: DataFrame) -> DataFrame:
    """Per column: type, role, row, null and non-finite counts, and extent, in one scan.

    The extent of a number column is in ``lo``/``hi``, that of a date column in
    ``t_lo``/``t_hi``.
    """
    asked, shape = ["count(*) AS rows"], []
    no_number, no_time = "CAST(NULL AS DOUBLE)", "CAST(NULL AS TIMESTAMP_NTZ)"
    for i, f in enumerate(df.schema.fields):
        kind = role(f.dataType)
        asked.append(f"count({quote_name(f.name)}) AS some{i}")
        numbers, times, odd = [no_number] * 2, [no_time] * 2, "0L"
        if kind != CATEGORY:
            value = _finite_sql(f.name, f.dataType)
            for side, pick in (("lo", "min"), ("hi", "max")):
                asked.append(f"{_measure_sql(f'{pick}({value})', f.dataType)} AS {side}{i}")
        if kind == DATE:
            times = [f"timestampadd(MICROSECOND, {side}{i}, {bins.EPOCH})" for side in ("lo", "hi")]
        elif kind == NUMBER:
            numbers = [f"lo{i}", f"hi{i}"]
        if _has_nonfinite(f.dataType):
            asked.append(f"count({value}) AS finite{i}")
            odd = f"some{i} - finite{i}"
        shape.append(
            f"{i}, {string_literal(f.name)}, {string_literal(type_name(f.dataType))}, '{kind}', "
            f"{str(f.nullable).lower()}, rows, rows - some{i}, {odd}, "
            f"{', '.join(numbers + times)}"
        )
    names = "pos, column, type_name, role, nullable, n_rows, n_null, n_nonfinite, lo, hi, t_lo, t_hi"
    return df.selectExpr(*asked).selectExpr(
        f"stack({len(shape)}, {', '.join(shape)}) AS ({names})"
    )
