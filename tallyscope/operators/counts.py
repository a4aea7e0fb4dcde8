"""Row counts and the status line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.baseline import Baseline
from tallyscope.operators.selection import Selection


def row_count(base: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """``(count)``: rows that meet every clause."""
    return selection.apply(base, []).agg(F.count(F.lit(1)).alias("count"))


def status(base: DataFrame, selection: Selection, baseline: Baseline) -> DataFrame:
    """``(count, total, label)``; the label reads ``N rows`` or ``N of M rows``.

    The whole table is counted once, the filtered rows with the filter at the scan.
    """
    whole = baseline.total(lambda: row_count(base))
    left = row_count(base, selection) if selection.clauses else whole
    both = left.selectExpr("`count`", "0L AS total").union(whole.selectExpr("0L", "`count`"))
    return both.selectExpr("sum(`count`) AS `count`", "sum(total) AS total").selectExpr(
        "`count`", "total",
        "CASE WHEN `count` = total THEN concat(format_number(total, 0), ' rows') ELSE "
        "concat(format_number(`count`, 0), ' of ', format_number(total, 0), ' rows') END AS label",
    )
