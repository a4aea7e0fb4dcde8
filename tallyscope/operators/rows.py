"""The row view: order, pages, seeking and row numbers."""

from __future__ import annotations

import datetime as dt
from itertools import groupby, islice, takewhile

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.columns import field, orderable
from tallyscope.functions.sqltext import literal, quote_name

PAGE = 100


@dataclass(frozen=True)
class SortKey:
    column: str
    sql: str
    descending: bool

    def order_sql(self) -> str:
        return f"{self.sql} {'DESC' if self.descending else 'ASC'} NULLS LAST"

    def order(self) -> Column:
        c = F.expr(self.sql)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_last()


def _key_sql(f: T.StructField) -> str:
    name = quote_name(f.name)
    if orderable(f.dataType):
        return name
    if isinstance(f.dataType, T.MapType) and orderable(f.dataType.keyType) and orderable(f.dataType.valueType):
        return f"array_sort(map_entries({name}))"
    return f"CAST({name} AS STRING)" if isinstance(f.dataType, T.NullType) else f"to_json({name})"


def chosen_keys(schema: T.StructType, sorts: Mapping[str, str]) -> list[SortKey]:
    """Sort keys in schema order, whatever order they were chosen in."""
    return [
        SortKey(f.name, _key_sql(f), sorts[f.name] == "desc")
        for f in schema.fields
        if f.name in sorts
    ]


def total_keys(schema: T.StructType, sorts: Mapping[str, str]) -> list[SortKey]:
    """Chosen keys, then every other column, so that no two different rows tie."""
    rest = [SortKey(f.name, _key_sql(f), False) for f in schema.fields if f.name not in sorts]
    return chosen_keys(schema, sorts) + rest


def ordered(df: DataFrame, keys: list[SortKey]) -> DataFrame:
    """The whole table in order.

    Rows are range-partitioned by the keys and, within equal keys, by where
    they come from, so that a frequent key is spread over several tasks.
    """
    if not keys:
        return df
    stamp = _fresh(df, "_stamp")
    spread = df.withColumn(stamp, F.monotonically_increasing_id())
    return spread.orderBy(*[k.order() for k in keys], F.col(stamp)).drop(stamp)


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def page(df: DataFrame, keys: list[SortKey], number: int = 0, size: int = PAGE) -> DataFrame:
    """Page ``number`` as one top-k: each task keeps ``(number + 1) * size`` rows.

    Meant for the first pages; use ``rows_after`` or ``pages`` to go deep.
    """
    out = df.orderBy(*[k.order() for k in keys]) if keys else df
    if number:
        out = out.offset(number * size)
    return out.limit(size)


def numbered_page(
    df: DataFrame, keys: list[SortKey], number: int = 0, size: int = PAGE
) -> DataFrame:
    """A page with the zero-based row number of the whole view, in ``row``."""
    window = Window.orderBy(*[k.order() for k in keys])
    place = F.row_number().over(window) - 1 + number * size
    # The window sees one page, never the table.
    return page(df, keys, number, size).withColumn("row", place.cast("bigint"))


def _equal_sql(key: SortKey, value: str | None) -> str:
    """Equality as in the order; NaN by name, as statistics of cached batches leave it out."""
    if value is None:
        return f"{key.sql} IS NULL"
    return f"isnan({key.sql})" if value == "double('NaN')" else f"{key.sql} = {value}"


def after_sql(keys: list[SortKey], last: list[str | None]) -> str:
    """Rows that sort strictly after ``last``, NULLs last in both directions.

    ``last`` holds one SQL literal per key, None for NULL.
    """
    branches = []
    equal: list[str] = []
    for key, value in zip(keys, last, strict=True):
        if value is not None:
            sign = "<" if key.descending else ">"
            later = f"({key.sql} {sign} {value} OR {key.sql} IS NULL)"
            branches.append(" AND ".join([*equal, later]))
        equal.append(_equal_sql(key, value))
    return " OR ".join(f"({b})" for b in branches) or "false"


def _key_literals(df: DataFrame, keys: list[SortKey], last: Row) -> list[str | None]:
    """A literal per key. Columns without an order are compared by their sorted entries or their
    JSON, which Spark itself makes for the one row."""
    plain = {k.column: field(df.schema, k.column) for k in keys}
    texts = {c: f for c, f in plain.items() if not orderable(f.dataType)}
    said: dict[str, tuple] = {}
    if texts:
        row = df.sparkSession.createDataFrame([[last[c] for c in texts]], T.StructType(list(texts.values())))
        made = row.selectExpr(*[_key_sql(f) for f in texts.values()])
        said = {c: (v, f.dataType) for c, v, f in zip(texts, made.head(), made.schema.fields, strict=True)}
    values = []
    for key in keys:
        dtype = plain[key.column].dataType
        value = last[key.column]
        if key.column in texts:
            value, dtype = said[key.column]
        value = _in_utc(value, dtype)
        values.append(None if value is None else literal(value, dtype))
    return values


def _in_utc(value: object, dtype: T.DataType) -> object:
    """Timestamps come to the driver in its own zone, also inside other values."""
    if value is None:
        return None
    if isinstance(dtype, T.TimestampType) and value.tzinfo is None:
        return value.astimezone(dt.timezone.utc)
    if isinstance(dtype, T.ArrayType):
        return [_in_utc(x, dtype.elementType) for x in value]
    if isinstance(dtype, T.StructType):
        return [_in_utc(x, f.dataType) for x, f in zip(value, dtype.fields, strict=True)]
    return value


def _from_sql(keys: list[SortKey], values: list[str | None]) -> tuple[str, str]:
    """Which rows equal ``values``, and which sort after them, with a bound on the leading key alone."""
    same = " AND ".join(_equal_sql(k, v) for k, v in zip(keys, values, strict=True))
    after, lead = after_sql(keys, values), keys[0]
    if values[0] is not None:
        sign = "<=" if lead.descending else ">="
        after = f"({after}) AND ({lead.sql} {sign} {values[0]} OR {lead.sql} IS NULL)"
    return same, after


def rows_after(
    df: DataFrame, keys: list[SortKey], last: Row, size: int = PAGE, shown: int = 1
) -> DataFrame:
    """The ``size`` rows that follow ``last``, by seeking rather than skipping.

    ``keys`` cover all columns, so rows equal to ``last`` are interchangeable: they
    are counted, and those beyond the ``shown`` ones given so far come first. The
    cost does not grow with the depth, and the leading key's bound can reach the scan.
    """
    same, after = _from_sql(keys, _key_literals(df, keys, last))
    later = df.where(after)
    copies = df.where(same).agg(F.count("*").alias("n"), F.any_value(F.struct("*")).alias("r"))
    rest = F.greatest(F.least(F.col("n") - shown, F.lit(size)), F.lit(0)).cast("int")
    again = copies.select(F.explode(F.array_repeat("r", rest)).alias("r")).select("r.*")
    return page(again.union(page(later, keys, 0, size)), keys, 0, size)


@dataclass(frozen=True)
class Page:
    first: int
    rows: list[Row]
    last: bool


# So many pages are sought one by one, each by scans of its own.
SOUGHT = 8


def pages(df: DataFrame, keys: list[SortKey], size: int = PAGE) -> Iterator[Page]:
    """All pages in order. The first ``SOUGHT`` come by seeks; who goes on has the rest sorted
    once, so that the cost does not grow with the number of pages. The driver holds a page and
    the next, later a page and one partition of the sorted rows."""
    held, first, shown = page(df, keys, 0, size).collect(), 0, 0
    while True:
        if held:
            tail = sum(1 for _ in takewhile(lambda r: repr(r) == repr(held[-1]), reversed(held)))
            shown = tail + (shown if tail == len(held) else 0)
        if len(held) < size:
            yield Page(first, held, True)
            return
        before = held[-1]
        if first == SOUGHT * size:
            break
        following = rows_after(df, keys, before, size, shown).collect()
        yield Page(first, held, not following)
        if not following:
            return
        held, first = following, first + size
        if repr(held[0]) != repr(before):  # NaN is equal to NaN here
            shown = 0
    same, later = _from_sql(keys, _key_literals(df, keys, before))
    rest = islice(ordered(df.where(f"({same}) OR ({later})"), keys).toLocalIterator(), shown, None)
    while held:
        following = list(islice(rest, size))
        yield Page(first, held, not following)
        held, first = following, first + size


def page_ends(df: DataFrame, keys: list[SortKey], size: int = PAGE, *more: Column) -> DataFrame:
    """A row per page of the whole view: ``first_row``, ``n_rows``, ``last_page`` and ``more`` aggregates of its rows.

    No page comes to the driver; the rows are numbered, and the pages counted by number."""
    row = _fresh(df, "_row")
    paged = number_rows(df, keys, row).groupBy((F.col(row) - F.col(row) % size).alias("first_row"))
    paged = paged.agg(F.count("*").alias("n_rows"), *more)
    last = F.col("first_row") + F.col("n_rows") == df.agg(F.count("*")).scalar()
    return paged.select("first_row", "n_rows", last.alias("last_page"), *paged.columns[2:])


# Of so many buckets of the keys' hashes each gives one key, and one hash in
# ``THINNED`` is looked at: at most ``RANGES`` bounds, whatever the table.
RANGES = 8192
THINNED = 64


def number_rows(df: DataFrame, keys: list[SortKey], name: str = "row") -> DataFrame:
    """Zero-based row numbers over the whole view, without a one-task window.

    Lazy: one plan finds the bounds, counts the rows of each range and numbers
    the rows inside the ranges. The bounds depend on the rows' content alone,
    so however often a part is computed, a row falls into the same range.
    Copies of a row, equal in all keys, share a range.
    """
    return _numbered(df, keys, name)


def _packed(keys: list[SortKey]) -> list[tuple[str, bool]]:
    """Runs of keys with one direction, each as a struct whose natural order is that of its
    keys, or their reverse. Structs put NULL first, which is last in reverse; else a flag
    before each key does that."""
    runs = [(down, list(run)) for down, run in groupby(keys, lambda k: k.descending)]
    return [(f"struct({', '.join(k.sql if down else f'{k.sql} IS NULL, {k.sql}' for k in run)})", down) for down, run in runs]


def _before(a: list[Column], b: list[Column], down: list[bool]) -> Column:
    """Whether the packed keys ``a`` sort strictly before ``b``; NULL if there is no ``a``."""
    *others, last = zip(a, b, down, strict=True)

    def sooner(x: Column, y: Column, reverse: bool) -> Column:
        return x > y if reverse else x < y

    out = sooner(*last)
    for x, y, reverse in reversed(others):
        out = F.when(sooner(x, y, reverse), True).when(sooner(y, x, reverse), False).otherwise(out)
    return out


def _numbered(df: DataFrame, keys: list[SortKey], name: str) -> DataFrame:
    packed, down = zip(*_packed(keys), strict=True)
    parts = [_fresh(df, f"_key{i}") for i in range(len(packed))]
    range_, of, place, size, start = (_fresh(df, n) for n in ("_range", "_of", "_place", "_size", "_start"))
    columns = [F.col(quote_name(c)) for c in df.columns]
    keyed = df.selectExpr("*", *[f"{sql} AS {p}" for sql, p in zip(packed, parts, strict=True)])
    only = keyed.select(*parts)

    def fields(c: Column) -> list[Column]:
        return [c.getField(p) for p in parts]

    def order(x: Column, y: Column) -> Column:
        return F.when(_before(fields(x), fields(y), down), -1).when(_before(fields(y), fields(x), down), 1).otherwise(0)

    thinned = only.select(F.struct(*parts).alias("b"), F.xxhash64(*parts).alias("h")).where(f"pmod(h, {THINNED}) = 0")
    bounds = thinned.groupBy(F.expr(f"pmod(shiftright(h, 16), {RANGES})")).agg(F.min_by("b", "h").alias("b"))
    bounds = bounds.agg(F.array_sort(F.collect_list("b"), order))

    widths = F.array(*[F.lit(1 << k) for k in reversed(range(RANGES.bit_length()))])
    found = _fresh(df, "_bounds")

    def place_among(row: Column) -> Column:
        """How many bounds sort before the row, by halving."""
        bound = lambda i: fields(F.get(row.getField(found), i))
        return F.aggregate(widths, F.lit(0), lambda at, k: at + F.when(_before(bound(at + k - 1), fields(row), down), k).otherwise(0))

    def placed(frame: DataFrame, *more: Column) -> DataFrame:
        # The bounds are named once, inside an array, so that the projections become one and all
        # comparisons see the same value. As a column of their own they are copied for each row.
        frame = frame.select(*more, *parts, bounds.scalar().alias(found))
        return frame.select(*more, F.transform(F.array(F.struct(found, *parts)), place_among)[0].alias(range_))

    # Two frames over the same rows: the counts need the keys only.
    starts = placed(only).groupBy(F.col(range_).alias(of)).agg(F.count("*").alias(size))
    # A row per range in both: the sums and the join see at most RANGES + 1 rows.
    starts = starts.select(of, (F.sum(size).over(Window.orderBy(of)) - F.col(size)).alias(start))
    inside = Window.partitionBy(range_).orderBy(*[k.order() for k in keys])
    rows = placed(keyed, *columns).withColumn(place, F.row_number().over(inside) - 1)
    joined = rows.join(F.broadcast(starts), F.col(range_) == F.col(of))
    return joined.select(*columns, (F.col(start) + F.col(place)).cast("bigint").alias(name))
