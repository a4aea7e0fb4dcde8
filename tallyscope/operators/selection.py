"""Filter clauses and the cross-filter.

A selection holds at most one clause per column. A view of a column sees the
clauses of all *other* columns; the rows and the row count see every clause.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field as dataclass_field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.columns import field, text_sql
from tallyscope.functions.sqltext import literal, quote_name, string_literal


@dataclass(frozen=True)
class ValueIs:
    """The column's text equals ``key``."""

    column: str
    key: str

    def sql(self, schema: T.StructType) -> str:
        dtype = field(schema, self.column).dataType
        typed = _typed_key(self.key, dtype)
        if typed is not None:
            # Same rows as comparing texts, but the scan can skip row groups.
            return f"{quote_name(self.column)} = {typed}"
        return f"{text_sql(self.column, dtype)} = {string_literal(self.key)}"


@dataclass(frozen=True)
class IsNull:
    column: str

    def sql(self, schema: T.StructType) -> str:
        return f"{quote_name(self.column)} IS NULL"


@dataclass(frozen=True)
class Between:
    """A brushed range; NULL is outside, and so is NaN."""

    column: str
    lo: object
    hi: object
    include_hi: bool = True

    def sql(self, schema: T.StructType) -> str:
        dtype = field(schema, self.column).dataType
        name = quote_name(self.column)
        lo, hi = literal(self.lo, dtype), literal(self.hi, dtype)
        if self.include_hi:
            return f"{name} BETWEEN {lo} AND {hi}"
        return f"({name} >= {lo} AND {name} < {hi})"


@dataclass(frozen=True)
class OccursOnce:
    """The column's text occurs exactly once in the unfiltered table."""

    column: str

    def sql(self, schema: T.StructType, table: str) -> str:
        value = text_sql(self.column, field(schema, self.column).dataType)
        return f"{value} IN (SELECT {value} FROM {table} GROUP BY {value} HAVING count(*) = 1)"


Clause = ValueIs | IsNull | Between | OccursOnce


def _typed_key(key: str, dtype: T.DataType) -> str | None:
    """A literal of the column's own type for ``key``, when its text is the same."""
    if isinstance(dtype, T.BooleanType) and key in ("true", "false"):
        return key
    if isinstance(dtype, T.IntegralType):
        try:
            number = int(key)
        except ValueError:
            return None
        return literal(number) if str(number) == key else None
    if isinstance(dtype, T.DateType):
        try:
            day = dt.date.fromisoformat(key)
        except ValueError:
            return None
        return literal(day) if day.isoformat() == key else None
    return None


# Longer texts are told apart by their digest.
SHORT = 24
DIGEST = "md5({0})"


def digest_sql(value: str) -> str:
    """A value of at most ``SHORT`` bytes itself, a longer one as 32 digits: never the same."""
    return f"CASE WHEN octet_length({value}) <= {SHORT} THEN {value} ELSE {DIGEST.format(value)} END"


def _lone_rows(base: DataFrame, columns: list[str], wanted: list[str], test: str) -> DataFrame:
    """Rows that meet ``test`` and whose value in each of ``columns`` occurs once in ``base``.

    Rows are grouped by the value and carry themselves along, so there is no
    join: the rows of a frequent value become one row per task before anything
    is shuffled, and rows that fail ``test`` are counted without their content.
    """
    struct = f"struct({', '.join(map(quote_name, wanted))})"

    def key(name: str) -> str:
        return f"{digest_sql(text_sql(name, field(base.schema, name).dataType))} AS k"

    first, *more = columns
    marks = base.selectExpr(key(first), f"CASE WHEN {test} THEN {struct} END AS r", "1L AS n")
    for name in more:
        rows = _once(marks)
        again = rows.selectExpr("r.*").selectExpr(key(name), f"{struct} AS r", "0L AS n")
        marks = base.selectExpr(key(name), f"CASE WHEN false THEN {struct} END AS r", "1L AS n").union(again)
    return _once(marks).selectExpr("r.*")


def _once(marks: DataFrame) -> DataFrame:
    grouped = marks.where("k IS NOT NULL").groupBy("k").agg(F.expr("sum(n) AS n"), F.expr("any_value(r, true) AS r"))
    return grouped.where("n = 1 AND r IS NOT NULL").select("r")


@dataclass(frozen=True)
class Selection:
    clauses: dict[str, Clause] = dataclass_field(default_factory=dict)

    def set(self, clause: Clause) -> Selection:
        return replace(self, clauses={**self.clauses, clause.column: clause})

    def clear(self, column: str | None = None) -> Selection:
        """Drop one column's clause, or every clause."""
        if column is None:
            return Selection()
        return Selection({c: v for c, v in self.clauses.items() if c != column})

    def toggle(self, clause: Clause) -> Selection:
        """Set the clause, or drop it when it is the one already set."""
        if self.clauses.get(clause.column) == clause:
            return self.clear(clause.column)
        return self.set(clause)

    def excluding(self, *columns: str) -> Selection:
        return Selection({c: v for c, v in self.clauses.items() if c not in columns})

    def where_sql(self, schema: T.StructType, table: str) -> str:
        """The conjunction as SQL text; empty when nothing is selected."""
        parts = [
            c.sql(schema, table) if isinstance(c, OccursOnce) else c.sql(schema)
            for c in self.clauses.values()
        ]
        return " AND ".join(parts)

    def once(self) -> list[str]:
        """Columns whose value is to occur once."""
        return [c for c, clause in self.clauses.items() if isinstance(clause, OccursOnce)]

    def tests(self, schema: T.StructType) -> dict[str, str]:
        """A SQL test for each plain clause."""
        return {c: v.sql(schema) for c, v in self.clauses.items() if not isinstance(v, OccursOnce)}

    def apply(self, base: DataFrame, wanted: list[str] | None = None) -> DataFrame:
        """Rows of ``base`` that meet every clause; plain clauses reach the scan.

        With ``wanted`` only these columns need to be there.
        """
        tests, once = self.tests(base.schema), self.once()
        if once:
            columns = base.columns if wanted is None else list(dict.fromkeys([*wanted, *once]))
            return _lone_rows(base, once, columns, all_of(tests.values()))
        out = base
        for test in tests.values():
            out = out.where(test)
        return out


def all_of(tests: Iterable[str]) -> str:
    """Conjunction of SQL tests; true when there is nothing to test."""
    return " AND ".join(f"({t})" for t in tests) or "true"

