"""One scan for many columns.

The columns to summarise are turned into rows of place and value and grouped
straight away, so the map side sends only partial counts. ``posexplode`` over an
array of the values does that in generated code with an int as the first
grouping key; it took half the time of ``unpivot``, whose key is a string.
Baseline and filtered counts ride along in the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.columns import field, text_sql
from tallyscope.operators.selection import Selection, all_of

# Columns per pass. Passes read disjoint columns, so more of them cost no more
# reading; with many columns in one, the generated code is too long for the JIT.
BATCH = 20


# Drops rows of (..., value) before they are grouped.
Among = Callable[[DataFrame, str], DataFrame]


def long_counts(
    base: DataFrame,
    values: Mapping[int, tuple[str, str]],
    selection: Selection,
    value_name: str,
    by: Mapping[str, str] | None = None,
    filtered_only: bool = False,
    ignore: tuple[str, ...] = (),
    among: Among | None = None,
) -> DataFrame:
    """Count rows per ``(pos, value)``: ``n`` unfiltered and ``f`` filtered.

    ``values`` maps a position to its column name and the value to count, as
    SQL; ``by`` adds grouping columns. The clause on the counted column itself
    is left out of ``f`` (cross-filter), as are clauses on ``ignore``. With
    ``filtered_only`` rows outside the filter are dropped before grouping and
    only ``n`` is returned. ``among`` narrows the rows before they are grouped.
    """
    selection = selection.excluding(*ignore)
    passes = _lone_passes if selection.once() else _passes
    return passes(base, values, selection, value_name, by or {}, filtered_only, ignore, among)


def _passes(base, values, selection, value_name, by, filtered_only, ignore, among) -> DataFrame:
    batches = [
        _one_pass(base, dict(chunk), selection, value_name, by, filtered_only, among)
        for chunk in chunks(list(values.items()))
    ]
    return reduce(DataFrame.unionByName, batches)


def _lone_passes(base, values, selection, value_name, by, filtered_only, ignore, among) -> DataFrame:
    """With a clause on what occurs once: filtered counts from the rows it leaves, one pass per
    different filter, beside the unfiltered counts."""
    filters: dict[tuple, dict] = {}
    for pos, (name, sql) in values.items():
        filters.setdefault(tuple(c for c in selection.clauses if c != name), {})[pos] = (name, sql)
    parts = []
    for columns, mine in filters.items():
        chosen = Selection({c: selection.clauses[c] for c in columns})
        rows = chosen.apply(base, [name for name, _ in mine.values()] + list(ignore))
        parts.append(_passes(rows, mine, Selection(), value_name, by, True, ignore, among))
    filtered = reduce(DataFrame.unionByName, parts)
    if filtered_only:
        return filtered
    keys = ["pos", *by, value_name]
    whole = _passes(base, values, Selection(), value_name, by, True, ignore, among)
    both = whole.selectExpr(*keys, "n", "0L AS f").unionByName(filtered.selectExpr(*keys, "0L AS n", "n AS f"))
    return both.groupBy(*keys).agg(F.expr("sum(n) AS n"), F.expr("sum(f) AS f"))


def _one_pass(base, values, selection, value_name, by, filtered_only, among) -> DataFrame:
    tests = selection.tests(base.schema)
    # One flag for most columns, and one more per summarised column that has
    # a clause of its own.
    own = {pos: name for pos, (name, _) in values.items() if name in tests}
    flags = {"keep": all_of(tests.values())} if tests and len(own) < len(values) else {}
    for pos, name in own.items():
        flags[f"keep{pos}"] = all_of(t for c, t in tests.items() if c != name)
    if filtered_only and flags:
        # Rows that no column wants; comparisons as plain as they come reach the scan.
        base = base.where(" OR ".join(f"({t})" for t in dict.fromkeys(flags.values())))
        if len(values) == 1:
            flags, tests = {}, {}
    # Flags and values are computed here, once per row.
    wide = base.selectExpr(
        *[f"{sql} AS {name}" for name, sql in {**by, **flags}.items()],
        *[f"{sql} AS c{pos}" for pos, (_, sql) in values.items()],
    )
    positions = list(values)
    if len(values) == 1:
        (pos,) = positions
        long = wide.withColumnRenamed(f"c{pos}", value_name)
        kept = f"keep{pos}" if own else "keep"
        pos_sql, group = f"{pos}", [*by, value_name]
    else:
        listed = ", ".join(f"c{pos}" for pos in positions)
        long = wide.selectExpr(*by, *flags, f"posexplode(array({listed})) AS (place, {value_name})")
        cases = " ".join(f"WHEN {positions.index(pos)} THEN keep{pos}" for pos in own)
        rest = "ELSE keep" if "keep" in flags else ""
        kept = f"CASE place {cases} {rest} END" if own else "keep"
        pos_sql = f"get(array({', '.join(map(str, positions))}), place)"
        group = ["place", *by, value_name]

    counts = ["count(*) AS n"]
    if filtered_only:
        long = long.where(kept) if tests else long
    else:
        counts.append(f"count_if({kept}) AS f" if tests else "count(*) AS f")
    if among is not None:
        long = among(long, value_name)
    counted = long.groupBy(*group).agg(*[F.expr(c) for c in counts])
    names = [c.rsplit(" ", 1)[1] for c in counts]
    return counted.selectExpr(f"{pos_sql} AS pos", *by, value_name, *names)


def text_values(base: DataFrame, columns: Mapping[int, str]) -> dict[int, tuple[str, str]]:
    return {
        pos: (name, text_sql(name, field(base.schema, name).dataType))
        for pos, name in columns.items()
    }


def chunks(items: list) -> list[list]:
    return [items[i : i + BATCH] for i in range(0, len(items), BATCH)]
