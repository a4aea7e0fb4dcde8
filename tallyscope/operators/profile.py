"""Whole-table profile: every column summarised by its role.

The extents take one scan, the bins of all histogram columns one, the values of
all category columns one, and repeated long texts one more of their columns.
The passes read disjoint columns (and those the filters need). Under another
filter only the filtered rows are counted again.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame

from tallyscope.functions.columns import CATEGORY, field, role, type_name
from tallyscope.functions.sqltext import string_literal
from tallyscope.operators.baseline import Baseline
from tallyscope.operators.categories import TOP, top_and_rest
from tallyscope.operators.histogram import Bins, bin_rows, bins_compared, constant_sql
from tallyscope.operators.seen import seen_compared
from tallyscope.operators.selection import Selection


def profile(
    base: DataFrame,
    columns: list[str],
    bins: Mapping[str, Bins],
    selection: Selection = Selection(),
    top: int = TOP,
    baseline: Baseline | None = None,
) -> DataFrame:
    """One row per bin, top value, rest, unique and null bucket of every column.

    ``total`` counts the unfiltered table, ``filtered`` the rows under the
    clauses of all *other* columns. Number bins have their edges in
    ``x1``/``x2``, date bins in ``t1``/``t2``; category rows have ``key``.
    """
    baseline = baseline or Baseline()
    if not columns:
        raise ValueError("there are no columns to profile")
    types = [field(base.schema, c).dataType for c in columns]
    listed = {p: c for p, c in enumerate(columns) if role(types[p]) == CATEGORY}
    binned = {p: c for p, c in enumerate(columns) if p not in listed}

    def named(values: list[str]) -> str:
        return constant_sql({p: string_literal(v) for p, v in enumerate(values)})

    lead = (
        "pos",
        f"{named(columns)} AS column",
        f"{named([type_name(t) for t in types])} AS type_name",
        f"{named([role(t) for t in types])} AS role",
        "kind",
    )
    parts = []
    if binned:
        counted = bins_compared(base, binned, bins, selection, baseline)
        parts.append(
            bin_rows(counted, binned, bins).selectExpr(
                *lead, "CAST(NULL AS INT) AS rank", "CAST(NULL AS STRING) AS key",
                "x1", "x2", "t1", "t2", "CAST(NULL AS BIGINT) AS n_values",
                "n AS total", "f AS filtered",
            )
        )
    if listed:
        parts.append(
            top_and_rest(seen_compared(base, listed, selection, baseline), top).selectExpr(
                *lead, "rank", "key",
                "CAST(NULL AS DOUBLE) AS x1", "CAST(NULL AS DOUBLE) AS x2",
                "CAST(NULL AS TIMESTAMP_NTZ) AS t1", "CAST(NULL AS TIMESTAMP_NTZ) AS t2",
                "n_values", "total", "filtered",
            )
        )
    return reduce(DataFrame.unionByName, parts)
