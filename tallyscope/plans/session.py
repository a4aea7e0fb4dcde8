"""A table under inspection: its filters, its order and its views.

A session is immutable; every change of state returns a new one. Sessions that
come from each other share the unfiltered extents, measured at most once per
column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession

from tallyscope.functions.columns import CATEGORY, field, role, roles
from tallyscope.functions.display import preview
from tallyscope.functions.sqltext import quote_name, quote_table
from tallyscope.operators import categories, counts, histogram, rows
from tallyscope.operators.baseline import Baseline
from tallyscope.operators.cube import Cube
from tallyscope.operators.extent import Extent, extents, histogram_columns
from tallyscope.operators.profile import profile
from tallyscope.operators.selection import Between, Clause, IsNull, OccursOnce, Selection, ValueIs
from tallyscope.sources.files import TEXT_FORMATS, FileSource, open_file
from tallyscope.sources.tables import free_name, from_data, read_query, read_table, register


@dataclass(frozen=True)
class Session:
    base: DataFrame
    table: str = "df"
    source: FileSource | None = None
    selection: Selection = dataclass_field(default_factory=Selection)
    sorts: dict[str, str] = dataclass_field(default_factory=dict)
    _extents: dict[str, Extent] = dataclass_field(default_factory=dict, compare=False, repr=False)
    _baseline: Baseline = dataclass_field(default_factory=Baseline, compare=False, repr=False)
    _kept: DataFrame | None = dataclass_field(default=None, compare=False, repr=False)

    # -- opening -----------------------------------------------------------

    @classmethod
    def of(
        cls, spark: SparkSession, data: object, table: str | None = None, columns: list[str] | None = None
    ) -> Session:
        """Profile a Spark DataFrame or in-memory data, registered as ``table``.

        Without a name it becomes ``df``, or the first of ``df_2``, ``df_3`` ...
        that is free, so that the SQL of each session stays its own.
        """
        df, table = _subset(from_data(spark, data), columns), table or free_name(spark)
        return cls(register(df, table), table)

    @classmethod
    def of_file(
        cls,
        spark: SparkSession,
        path: str,
        fmt: str | None = None,
        table: str | None = None,
        columns: list[str] | None = None,
        schema=None,
        keep: bool = True,
        multiline: bool | None = None,
        header: bool = True,
        sep: str | None = None,
    ) -> Session:
        """Profile a file, folder or URL that Spark can read."""
        df, source = open_file(spark, path, fmt, schema, keep, multiline, header, sep)
        table = table or free_name(spark)
        kept = df if keep and source.fmt in TEXT_FORMATS else None
        return cls(register(_subset(df, columns), table), table, source, _kept=kept)

    @classmethod
    def of_table(
        cls, spark: SparkSession, name: str, columns: list[str] | None = None
    ) -> Session:
        """Profile a table or view of the catalog."""
        return cls(_subset(read_table(spark, name), columns), name)

    @classmethod
    def of_query(cls, spark: SparkSession, text: str, table: str | None = None) -> Session:
        table = table or free_name(spark)
        return cls(register(read_query(spark, text), table), table)

    # -- state -------------------------------------------------------------

    def where(self, clause: Clause) -> Session:
        field(self.base.schema, clause.column)
        return replace(self, selection=self.selection.set(clause))

    def toggle(self, clause: Clause) -> Session:
        field(self.base.schema, clause.column)
        return replace(self, selection=self.selection.toggle(clause))

    def where_value(self, column: str, key: str | None) -> Session:
        return self.where(IsNull(column) if key is None else ValueIs(column, key))

    def where_null(self, column: str) -> Session:
        return self.where(IsNull(column))

    def where_range(self, column: str, lo, hi, include_hi: bool = True) -> Session:
        return self.where(Between(column, lo, hi, include_hi))

    def where_unique(self, column: str) -> Session:
        return self.where(OccursOnce(column))

    def clear(self, column: str | None = None) -> Session:
        return replace(self, selection=self.selection.clear(column))

    def sort(self, column: str, direction: str | None) -> Session:
        """``asc``, ``desc``, or None to drop the column from the order."""
        if direction not in ("asc", "desc", None):
            raise ValueError(f"direction is 'asc', 'desc' or None, not {direction!r}")
        field(self.base.schema, column)
        kept = {c: d for c, d in self.sorts.items() if c != column}
        return replace(self, sorts={**kept, column: direction} if direction else kept)

    # -- schema ------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return self.base.columns

    def roles(self) -> DataFrame:
        return roles(self.base.sparkSession, self.base.schema)

    # -- rows --------------------------------------------------------------

    def data(self) -> DataFrame:
        """The current view, whole and lazy."""
        return rows.ordered(self.selection.apply(self.base), self._chosen())

    def sql(self) -> str:
        """The current view as Spark SQL over the registered name."""
        return self._sql(quote_table(self.table))

    def export_sql(self) -> str:
        """The current view as SQL that names the source file instead."""
        name = quote_table(self.table)
        if self.source is None:
            return self.sql()
        inline = self.source.from_sql()
        if inline:
            return self._sql(inline)
        view = self.source.view_sql(name, self.base.schema)
        return f"{view};\n{self.sql()}" if view else self.sql()

    def page(self, number: int = 0, size: int = rows.PAGE) -> DataFrame:
        """Rows of one page of the total order: the sort, then all other columns."""
        return rows.page(self.selection.apply(self.base), self._total(), number, size)

    def numbered_page(self, number: int = 0, size: int = rows.PAGE) -> DataFrame:
        return rows.numbered_page(self.selection.apply(self.base), self._total(), number, size)

    def page_after(self, last: Row, size: int = rows.PAGE, shown: int = 1) -> DataFrame:
        """The rows that follow ``last`` in the total order; ``shown`` rows equal to it were given so far."""
        return rows.rows_after(self.selection.apply(self.base), self._total(), last, size, shown)

    def pages(self, size: int = rows.PAGE) -> Iterator[rows.Page]:
        seen = self.selection.apply(self.base)
        return rows.pages(seen, self._total(), size)

    def page_ends(self, size: int = rows.PAGE, *more: Column) -> DataFrame:
        """A row per page: ``first_row``, ``n_rows``, ``last_page`` and ``more`` aggregates of its rows."""
        return rows.page_ends(self.selection.apply(self.base), self._total(), size, *more)

    def numbered(self, name: str = "row") -> DataFrame:
        """All rows with their zero-based place in the total order."""
        return rows.number_rows(self.selection.apply(self.base), self._total(), name)

    def preview(self, number: int = 0, size: int = rows.PAGE) -> DataFrame:
        """One page as display text. The first one of an unsorted view is any rows, found without a full scan."""
        if self.sorts or number:
            return preview(self.page(number, size))
        return preview(rows.page(self.selection.apply(self.base), [], 0, size))

    # -- summaries ---------------------------------------------------------

    def count(self) -> DataFrame:
        return counts.row_count(self.base, self.selection)

    def status(self) -> DataFrame:
        return counts.status(self.base, self.selection, self._baseline)

    def bins(self, *columns: str) -> dict[str, histogram.Bins]:
        """Bin rules of histogram columns, from the unfiltered extents."""
        asked = list(columns) or histogram_columns(self.base.schema)
        missing = [c for c in asked if c not in self._extents]
        if missing:
            self._extents.update(extents(self.base, missing))
        return {c: self._extents[c].bins(self._role(c)) for c in asked}

    def histogram(self, column: str) -> DataFrame:
        return histogram.histogram(self.base, column, self.bins(column)[column], self.selection)

    def histogram_compare(self, column: str) -> DataFrame:
        bins = self.bins(column)[column]
        return histogram.histogram_compare(self.base, column, bins, self.selection, self._baseline)

    def value_counts(self, column: str) -> DataFrame:
        return categories.value_counts(self.base, column, self.selection)

    def value_counts_compare(self, column: str) -> DataFrame:
        return categories.value_counts_compare(self.base, column, self.selection, self._baseline)

    def top_values(self, column: str, top: int = categories.TOP) -> DataFrame:
        return categories.top_values(self.base, column, self.selection, self._baseline, top)

    def summary(self, column: str) -> DataFrame:
        """The view of a column that fits its role."""
        return self.value_counts(column) if self._role(column) == CATEGORY else self.histogram(column)

    def profile(self, columns: list[str] | None = None, top: int = categories.TOP) -> DataFrame:
        """Every column's summary."""
        chosen = columns or self.columns
        binned = [c for c in chosen if self._role(c) != CATEGORY]
        bins = self.bins(*binned) if binned else {}
        return profile(self.base, chosen, bins, self.selection, top, self._baseline)

    def close(self) -> None:
        """Release the remembered baseline and the kept text of this session and all that share them."""
        self._baseline.close()
        if self._kept is not None:
            self._kept.unpersist()

    def cube(self, active: str, targets: list[str] | None = None) -> Cube:
        """Counts by ``active`` for quick refreshes while its filter moves."""
        others = [c for c in (targets or self.columns) if c != active]
        binned = [c for c in [active, *others] if self._role(c) != CATEGORY]
        bins = self.bins(*binned) if binned else {}
        return Cube(self.base, active, others, bins, self._extents, self.selection)

    # -- internals ---------------------------------------------------------

    def _role(self, column: str) -> str:
        return role(field(self.base.schema, column).dataType)

    def _chosen(self) -> list[rows.SortKey]:
        return rows.chosen_keys(self.base.schema, self.sorts)

    def _total(self) -> list[rows.SortKey]:
        return rows.total_keys(self.base.schema, self.sorts)

    def _sql(self, table_sql: str) -> str:
        chosen = ", ".join(quote_name(c) for c in self.columns)
        out = f"SELECT {chosen} FROM {table_sql}" if self.columns else f"SELECT * FROM {table_sql}"
        where = self.selection.where_sql(self.base.schema, table_sql)
        if where:
            out += f" WHERE {where}"
        keys = self._chosen()
        if keys:
            out += " ORDER BY " + ", ".join(k.order_sql() for k in keys)
        return out


def _subset(df: DataFrame, columns: list[str] | None) -> DataFrame:
    return df if columns is None else df.select(*[quote_name(c) for c in columns])
