"""Histograms of number and date columns over fixed bins.

The bins come from the unfiltered extent, so filters change counts and never
edges. NULL has a row of its own (``kind = 'null'``, present even when empty),
and so have NaN and the infinities (``kind = 'nonfinite'``).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame

from tallyscope.functions.bins import (
    NONFINITE_SQL,
    DateBins,
    NumberBins,
    date_edge_sql,
    number_edge_sql,
)
from tallyscope.functions.columns import field
from tallyscope.operators.baseline import Baseline
from tallyscope.operators.longform import long_counts
from tallyscope.operators.selection import Selection

Bins = NumberBins | DateBins


def bin_values(
    base: DataFrame, columns: Mapping[int, str], bins: Mapping[str, Bins], exact: bool = False
) -> dict[int, tuple[str, str]]:
    return {
        pos: (name, bins[name].index_sql(name, field(base.schema, name).dataType, exact))
        for pos, name in columns.items()
    }


def bin_rows(
    counted: DataFrame, columns: Mapping[int, str], bins: Mapping[str, Bins]
) -> DataFrame:
    """``(pos, kind, x1, x2, t1, t2, n, f)`` from counts per bin index ``k``.

    Adds the NULL row where a column has none, and the edges: ``x1``/``x2``
    for numbers, ``t1``/``t2`` for dates. Works on counted bins only.
    """
    numbers = {p: bins[c] for p, c in columns.items() if isinstance(bins[c], NumberBins)}
    dates = {p: bins[c] for p, c in columns.items() if isinstance(bins[c], DateBins)}
    x = ["CAST(NULL AS DOUBLE)"] * 2
    if numbers:
        step = constant_sql({p: repr(r.step) + "D" for p, r in numbers.items()})
        origin = constant_sql({p: repr(r.origin) + "D" for p, r in numbers.items()})
        x = [number_edge_sql(k, step, origin) for k in ("k", "(k + 1)")]
    t = ["CAST(NULL AS TIMESTAMP_NTZ)"] * 2
    if dates:
        micros = constant_sql({p: f"{r.micros}L" for p, r in dates.items()})
        months = constant_sql({p: f"{r.months}L" for p, r in dates.items()})
        t = [date_edge_sql(k, micros, months) for k in ("k", "(k + 1)")]
    zeros = ", ".join(f"({pos}, CAST(NULL AS BIGINT), 0L, 0L)" for pos in columns)
    return counted.sparkSession.sql(
        f"""
        SELECT pos,
               CASE WHEN k IS NULL THEN 'null' WHEN k = {NONFINITE_SQL} THEN 'nonfinite'
                    ELSE 'value' END AS kind,
               {x[0]} AS x1, {x[1]} AS x2, {t[0]} AS t1, {t[1]} AS t2, n, f
        FROM (SELECT pos, k, sum(n) AS n, sum(f) AS f
              FROM (SELECT pos, k, n, f FROM {{counted}} UNION ALL VALUES {zeros})
              GROUP BY pos, k)
        """,
        counted=counted,
    )


def constant_sql(values: Mapping[int, str]) -> str:
    """The constant that belongs to ``pos``; NULL for other positions."""
    listed = ", ".join(values.get(p, "NULL") for p in range(max(values) + 1))
    return f"get(array({listed}), pos)"


def histogram(
    base: DataFrame, column: str, bins: Bins, selection: Selection = Selection()
) -> DataFrame:
    """``(kind, x1, x2, n)`` of one column under the clauses of all others."""
    values = bin_values(base, {0: column}, {column: bins})
    counted = long_counts(base, values, selection, "k", filtered_only=True)
    return one_column(counted.selectExpr("pos", "k", "n", "n AS f"), column, bins).drop("f")


def histogram_compare(
    base: DataFrame, column: str, bins: Bins, selection: Selection, baseline: Baseline
) -> DataFrame:
    """``(kind, x1, x2, n, f)``: baseline and filtered counts."""
    counted = bins_compared(base, {0: column}, {column: bins}, selection, baseline)
    return one_column(counted, column, bins)


def bins_compared(
    base: DataFrame, columns: Mapping[int, str], bins: Mapping[str, Bins], selection: Selection, baseline: Baseline
) -> DataFrame:
    """``(pos, k, n, f)`` for ``bin_rows``, which sums them.

    Columns not asked before take one scan for both counts; later only the
    filtered rows are counted, with the filter at the scan.
    """
    known = baseline.known("bins", columns)
    fresh = {p: c for p, c in columns.items() if p not in known}
    parts = []
    if fresh:
        counted = long_counts(base, bin_values(base, fresh, bins), selection, "k")
        parts.append(baseline.keep("bins", fresh, counted))
    free = {p: c for p, c in known.items() if not selection.excluding(c).clauses}
    if free:
        parts.append(baseline.rows("bins", free, "k", "n", "n AS f"))
    asked = {p: c for p, c in known.items() if p not in free}
    if asked:
        counted = long_counts(base, bin_values(base, asked, bins), selection, "k", filtered_only=True)
        parts += [baseline.rows("bins", asked, "k", "n", "0L AS f"), counted.selectExpr("pos", "k", "0L AS n", "n AS f")]
    return reduce(DataFrame.unionByName, parts)


def one_column(counted: DataFrame, column: str, bins: Bins) -> DataFrame:
    """Bin rows of the column at position 0, with its edges in ``x1``/``x2``."""
    lo, hi = ("t1", "t2") if isinstance(bins, DateBins) else ("x1", "x2")
    rows = bin_rows(counted, {0: column}, {column: bins})
    return rows.selectExpr("kind", f"{lo} AS x1", f"{hi} AS x2", "n", "f")
