"""Value counts: NULL apart, values seen once folded into ``unique``.

``kind`` tells what a row stands for, so no marker text can collide with data:
``value`` (``key`` holds the text), ``unique``, ``null`` and, in the top-k
form, ``rest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.baseline import Baseline
from tallyscope.operators.rows import SortKey, number_rows
from tallyscope.operators.seen import seen_compared, seen_values
from tallyscope.operators.selection import Selection

TOP = 20

# Up to here Spark ranks by a top-k in each partition.
SHORT_LIST = 900


def value_counts(
    base: DataFrame, column: str, selection: Selection = Selection()
) -> DataFrame:
    """``(kind, key, total)`` under the clauses of all other columns.

    Singletons are decided on the filtered rows.
    """
    seen = seen_values(base, {0: column}, selection, filtered_only=True)
    return seen.selectExpr("kind", "key", "n AS total")


def value_counts_compare(
    base: DataFrame, column: str, selection: Selection, baseline: Baseline
) -> DataFrame:
    """``(kind, key, total, filtered, fraction)``.

    Singletons are decided on the baseline, so a value filtered down to one
    row keeps its own key.
    """
    seen = seen_compared(base, {0: column}, selection, baseline)
    return seen.selectExpr("kind", "key", "n AS total", "f AS filtered", "f / n AS fraction")


def bar_totals(counts: DataFrame) -> DataFrame:
    """One row about the folded counts: what a bar chart of them needs."""
    return counts.selectExpr(
        "count_if(kind = 'value') AS n_values",
        "coalesce(sum(CASE WHEN kind = 'null' THEN total END), 0L) AS null_count",
        "coalesce(sum(CASE WHEN kind = 'unique' THEN total END), 0L) AS unique_count",
        "coalesce(sum(total), 0L) AS total",
    )


def category_label(counts: DataFrame) -> DataFrame:
    """``(n_rows, n_distinct, label)``: counted rows and truly distinct values."""
    return counts.selectExpr(
        "count(*) AS n_rows",
        "coalesce(sum(CASE kind WHEN 'value' THEN 1L WHEN 'unique' THEN total ELSE 0L END), 0L)"
        " AS n_distinct",
    ).selectExpr(
        "*",
        "concat(format_number(n_rows, 0), if(n_rows = 1, ' category', ' categories')) AS label",
    )


def by_falling_total(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("total"), "kind", F.col("key").asc_nulls_last())


def _ranked(seen: DataFrame, top: int) -> DataFrame:
    """Values with their ``rank`` within ``pos``, by falling count and then by text.

    A short list is one top-k. For a longer one Spark's window would gather all
    values of a column; they are numbered over ranges instead.
    """
    values = seen.where("kind = 'value'").select("pos", "kind", "key", "n_values", "n", "f")
    if top <= SHORT_LIST:
        order = "row_number() OVER (PARTITION BY pos ORDER BY n DESC, key) AS rank"
        return values.selectExpr("*", order)
    keys = [SortKey("pos", "pos", False), SortKey("n", "n", True), SortKey("key", "key", False)]
    firsts = values.groupBy(F.col("pos").alias("pos_")).agg(F.count("*").alias("many"))
    # One row per column of the table.
    firsts = firsts.selectExpr("pos_", "sum(many) OVER (ORDER BY pos_) - many AS before")
    numbered = number_rows(values, keys, "place").join(F.broadcast(firsts), F.col("pos") == F.col("pos_"))
    return numbered.selectExpr(*values.columns, "CAST(place - before + 1 AS INT) AS rank")


def top_and_rest(seen: DataFrame, top: int = TOP) -> DataFrame:
    """Per ``pos``: the ``top`` largest values, and ``rest``, ``unique``, ``null``.

    ``seen`` has the rows of ``seen_values``. The ranking of a short list keeps
    at most ``top`` rows per partition before it moves anything and all else
    are partial sums, so no step gathers the values of a column.
    """
    if top < 1:
        raise ValueError("top is 1 or more")
    return seen.sparkSession.sql(
        f"""
        WITH shown AS (SELECT pos, kind, rank, key, n_values, n, f FROM {{ranked}} WHERE rank <= {top}),
        sums AS (
          SELECT pos, CASE kind WHEN 'value' THEN 'rest' ELSE kind END AS kind, n_values, n, f FROM {{seen}}
          UNION ALL SELECT pos, 'rest', -n_values, -n, -f FROM shown
        )
        SELECT pos, kind, rank, key, n_values, n AS total, f AS filtered FROM shown
        UNION ALL
        SELECT pos, kind, CAST(NULL AS INT), CAST(NULL AS STRING), sum(n_values), sum(n), sum(f)
        FROM sums GROUP BY pos, kind HAVING sum(n_values) > 0
        """,
        seen=seen, ranked=_ranked(seen, top),
    )


def top_values(
    base: DataFrame, column: str, selection: Selection, baseline: Baseline, top: int = TOP
) -> DataFrame:
    """``(kind, rank, key, n_values, total, filtered)`` of one column."""
    return top_and_rest(seen_compared(base, {0: column}, selection, baseline), top).drop("pos")
