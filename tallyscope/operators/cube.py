"""Pre-aggregated cross-filter.

While one column's filter is being moved, only that column's clause changes.
The cube holds one row per bin or value of every other column, with its counts
summed up along the bins of the active column. A brushed range is then the
difference of two sums of the same row: nothing is grouped or shuffled but the
folding of what is left once.
"""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.bins import NONFINITE, NumberBins
from tallyscope.functions.columns import CATEGORY, field, role
from tallyscope.functions.sqltext import string_literal
from tallyscope.operators.extent import Extent
from tallyscope.operators.histogram import Bins, bin_rows, bin_values, constant_sql, one_column
from tallyscope.operators.longform import long_counts, text_values
from tallyscope.operators.selection import Between, Clause, IsNull, Selection, ValueIs


class Cube:
    """Counts of ``targets`` by the active column, under all other clauses."""

    def __init__(
        self,
        base: DataFrame,
        active: str,
        targets: list[str],
        bins: dict[str, Bins],
        extents: dict[str, Extent],
        selection: Selection = Selection(),
    ):
        self.active = active
        self.targets = {pos: name for pos, name in enumerate(targets) if name != active}
        if not self.targets:
            raise ValueError("a cube needs a target besides the active column")
        self._bins = bins
        self._extent = extents.get(active)
        if role(field(base.schema, active).dataType) == CATEGORY:
            ((_, slot),) = text_values(base, {0: active}).values()
        else:
            ((_, slot),) = bin_values(base, {0: active}, bins, exact=True).values()
        roles = {name: role(field(base.schema, name).dataType) for name in targets}
        binned = {p: n for p, n in self.targets.items() if roles[n] != CATEGORY}
        listed = {p: n for p, n in self.targets.items() if roles[n] == CATEGORY}
        self._binned = self._listed = None
        self._binned_columns = binned
        if binned:
            values = bin_values(base, binned, bins)
            self._binned = self._build(base, values, selection, "k", slot)
        if listed:
            values = text_values(base, listed)
            self._listed = self._build(base, values, selection, "v", slot)

    def _build(self, base, values, selection, value, slot) -> DataFrame:
        """``(pos, value, lone, total, none, odd, steps)``.

        ``steps`` lists the slots of the active column that occur: with the sum
        up to them where they have an order, else with their count. Values with
        a single row can only stay single or go: they share one ``lone`` row,
        so that a near-unique target has few rows.
        """
        counted = long_counts(
            base, values, selection, value,
            by={"a": slot}, filtered_only=True, ignore=(self.active,),
        )
        lists = F.expr("collect_list(struct(a, n)) AS steps")
        whole = counted.groupBy("pos", value).agg(lists, F.expr("sum(n) AS total"))
        single = f"total = 1 AND {value} IS NOT NULL" if value == "v" else "false"
        rows = whole.where(f"NOT ({single}) AND total > 0").selectExpr("pos", value, "false AS lone", "total", "steps")
        if value == "v":
            slots = whole.where(single).selectExpr("pos", "inline(steps)").groupBy("pos", "a").agg(F.expr("sum(n) AS n"))
            lone = slots.groupBy("pos").agg(lists, F.expr("sum(n) AS total"))
            rows = rows.unionByName(lone.selectExpr("pos", "CAST(NULL AS STRING) AS v", "true AS lone", "total", "steps"))
        count = "aggregate(filter(steps, s -> {0}), 0L, (t, s) -> t + s.n)"
        if self._extent is None:
            rows = rows.selectExpr("pos", value, "lone", "total", f"{count.format('s.a IS NULL')} AS none", "0L AS odd", "steps")
        else:
            along = f"array_sort(filter(steps, s -> s.a IS NOT NULL AND s.a <> {NONFINITE}))"
            rows = rows.selectExpr(
                "pos", value, "lone", "total", f"{count.format('s.a IS NULL')} AS none", f"{count.format(f's.a = {NONFINITE}')} AS odd",
                f"""aggregate({along}, CAST(array() AS ARRAY<STRUCT<a: BIGINT, n: BIGINT>>), (t, s) ->
                    concat(t, array(named_struct('a', s.a, 'n', s.n + coalesce(try_element_at(t, -1).n, 0L))))) AS steps""",
            )
        # Kept on the executors; a lost block is recomputed from the table.
        return rows.persist(StorageLevel.MEMORY_AND_DISK)

    def answers(self, clause: Clause | None) -> bool:
        """Whether the cube alone gives the exact answer for ``clause``."""
        return self._count_sql(clause) is not None

    def histogram(self, target: str, clause: Clause | None = None) -> DataFrame:
        """Same rows as the direct histogram of ``target`` under ``clause``."""
        self._must(target, target in self._bins, "histogram")
        counted = self._counted(self._binned, target, clause, "k")
        aligned = counted.selectExpr("0 AS pos", "k", "n", "n AS f")
        return one_column(aligned, target, self._bins[target]).drop("f")

    def value_counts(self, target: str, clause: Clause | None = None) -> DataFrame:
        """Same rows as the direct value counts of ``target`` under ``clause``."""
        self._must(target, target not in self._bins, "value counts")
        counted = self._counted(self._listed, target, clause, "v")
        return _folded(counted.selectExpr("0 AS pos", "*")).drop("pos")

    def refresh(self, clause: Clause | None = None) -> DataFrame:
        """All targets at once: ``(column, kind, key, x1, x2, t1, t2, total)``."""
        parts = []
        if self._binned is not None:
            counted = self._chosen(self._binned, clause).selectExpr("pos", "k", "n", "n AS f")
            rows = bin_rows(counted, self._binned_columns, self._bins)
            parts.append(
                rows.selectExpr(
                    "pos", "kind", "CAST(NULL AS STRING) AS key", "x1", "x2", "t1", "t2", "n AS total"
                )
            )
        if self._listed is not None:
            parts.append(
                _folded(self._chosen(self._listed, clause)).selectExpr(
                    "pos", "kind", "key",
                    *[f"CAST(NULL AS DOUBLE) AS {c}" for c in ("x1", "x2")],
                    *[f"CAST(NULL AS TIMESTAMP_NTZ) AS {c}" for c in ("t1", "t2")],
                    "total",
                )
            )
        named = constant_sql({p: string_literal(c) for p, c in self.targets.items()})
        rows = reduce(DataFrame.unionByName, parts)
        return rows.selectExpr(f"{named} AS column", *rows.columns[1:])

    def close(self) -> None:
        """Give the storage of the executors back."""
        for frame in (self._binned, self._listed):
            if frame is not None:
                frame.unpersist()

    def _must(self, target: str, holds: bool, view: str) -> None:
        self._place(target)
        if not holds:
            raise ValueError(f"this cube answers no {view} of {target!r}")

    def _place(self, target: str) -> int:
        for pos, name in self.targets.items():
            if name == target:
                return pos
        raise ValueError(f"{target!r} is not a target of this cube")

    def _counted(self, frame, target, clause, value) -> DataFrame:
        chosen = self._chosen(frame, clause).where(F.col("pos") == self._place(target))
        return chosen.select(value, "lone", "n")

    def _chosen(self, frame: DataFrame, clause: Clause | None) -> DataFrame:
        count = self._count_sql(clause)
        if count is None:
            raise ValueError(f"{clause} does not follow the cube's bins; ask directly")
        return frame.withColumn("n", F.expr(count)).where("n > 0")

    def _count_sql(self, clause: Clause | None) -> str | None:
        """The count of a row under ``clause``, if the row tells it exactly."""
        if clause is None:
            return "total"
        if clause.column != self.active:
            return None
        if isinstance(clause, IsNull):
            return "none"
        if self._extent is None:
            if not isinstance(clause, ValueIs):
                return None
            return f"aggregate(filter(steps, s -> s.a = {string_literal(clause.key)}), 0L, (t, s) -> t + s.n)"
        if not isinstance(clause, Between):
            return None
        rule, extent = self._bins[self.active], self._extent
        lo, hi = _position(clause.lo), _position(clause.hi)
        if extent.lo is None or lo is None or hi is None:
            return None
        if isinstance(rule, NumberBins) and max(abs(extent.lo), abs(extent.hi)) >= 2**53:
            return None  # a bigint may differ from its double
        before, upto = "0L", "(total - none - odd)"
        if lo > extent.lo:
            first = _edge_index(rule, lo)
            if first is None:
                return None
            before = _sum_before(first)
        if hi < extent.hi or (hi == extent.hi and not clause.include_hi):
            end = _edge_index(rule, hi)
            if end is None or clause.include_hi:
                return None
            upto = _sum_before(end)
        return f"greatest({upto} - {before}, 0L)"


def _sum_before(slot: int) -> str:
    return f"aggregate(filter(steps, s -> s.a < {slot}L), 0L, (t, s) -> greatest(t, s.n))"


def _folded(counted: DataFrame) -> DataFrame:
    """``(pos, kind, key, total)`` from ``(pos, v, lone, n)``: what is left once becomes ``unique``."""
    once = "(lone OR n = 1 AND v IS NOT NULL)"
    return counted.groupBy(
        "pos",
        F.expr(f"CASE WHEN {once} THEN 'unique' WHEN v IS NULL THEN 'null' ELSE 'value' END AS kind"),
        F.expr(f"CASE WHEN {once} THEN NULL ELSE v END AS key"),
    ).agg(F.expr("sum(n) AS total"))


def _position(value: object) -> float | int | None:
    """A range end on the scale of the extents; None when it has no exact place."""
    if isinstance(value, dt.date):
        if not isinstance(value, dt.datetime):
            value = dt.datetime(value.year, value.month, value.day)
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return (value - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    if isinstance(value, (int, float)) and math.isfinite(value) and abs(value) < 2**53:
        return float(value)
    return None


def _edge_index(rule: Bins, value: float | int) -> int | None:
    """The bin that starts at ``value``, if an edge lies exactly there."""
    if isinstance(rule, NumberBins):
        near = round((value - rule.origin) / rule.step)
        return near if rule.edge(near) == value else None
    if rule.micros:
        return value // rule.micros if value % rule.micros == 0 else None
    at = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=value)
    month = at.year * 12 + at.month - 1
    if at != dt.datetime(at.year, at.month, 1) or month % rule.months:
        return None
    return month // rule.months
