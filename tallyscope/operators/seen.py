"""Values seen more than once, in one pass for all columns and one more for long texts.

Grouping by a text moves every distinct text through the shuffle. Most long
texts occur once, and of those only the number is wanted. So texts beyond
``SHORT`` bytes are first grouped by a digest, together with the short values
of all columns. The digests seen more than once set bits in a bitmap of fixed
size; the second pass drops every long text whose bit is not set and groups
the others by themselves. A bit set by chance costs a little work and never a
wrong count.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.operators.baseline import Baseline
from tallyscope.operators.longform import long_counts, text_values
from tallyscope.operators.selection import DIGEST, SHORT, Selection, digest_sql

# Bits of the bitmap, a power of two. It is sent to every executor: 4 MB.
BITS = 1 << 25

NAMES = ("pos", "kind", "key", "id", "n_values", "n", "f")


def seen_values(
    base: DataFrame,
    columns: Mapping[int, str],
    selection: Selection = Selection(),
    filtered_only: bool = False,
) -> DataFrame:
    """``(pos, kind, key, id, n_values, n, f)``: one row per value seen more than once, one
    for NULL, and one ``unique`` row for all values seen once.

    ``n`` counts the unfiltered rows and decides what is seen once; with ``filtered_only``
    both count the filtered rows. ``id`` is the value itself, or the digest of a long one.
    """
    texts = text_values(base, columns)
    digests = {p: (c, digest_sql(v)) for p, (c, v) in texts.items()}
    counts = long_counts(base, digests, selection, "v", filtered_only=filtered_only)
    f = "n" if filtered_only else "f"
    counts = counts.selectExpr("pos", "v", "n", f"{f} AS f")
    # Each test reads a count, and the join below is null-safe, so that no test
    # is moved below the grouping: all branches then read the same exchange.
    long = f"octet_length(v) > {SHORT}"
    short = counts.where(f"CASE WHEN v IS NULL THEN n + 1 WHEN {long} THEN 0L ELSE n END > 1 AND f >= 0")
    bits = _bitmap(counts.where(f"CASE WHEN {long} THEN n ELSE 0L END > 1 AND f >= 0"))

    def repeated(rows: DataFrame, value: str) -> DataFrame:
        place = f"{_place(DIGEST.format(value))}"
        return (
            rows.where(f"octet_length({value}) > {SHORT}")
            .withColumn("_bit", F.expr(place))
            .join(F.broadcast(bits), F.expr("bitmap_bucket_number(_bit) <=> _bucket"))
            .where("getbit(CAST(conv(hex(substring(_map, CAST(bitmap_bit_position(_bit) DIV 8 + 1 AS INT), 1)), 16, 10) AS BIGINT), CAST(bitmap_bit_position(_bit) % 8 AS INT)) = 1")
            .drop("_bit", "_bucket", "_map")
        )

    long_values = long_counts(base, texts, selection, "v", filtered_only=filtered_only, among=repeated)
    long_values = long_values.selectExpr("pos", "v", "n", f"{f} AS f").where("n > 1 AND f >= 0")
    values = short.selectExpr(
        "pos", "CASE WHEN v IS NULL THEN 'null' ELSE 'value' END AS kind", "v AS key", "v AS id", "n", "f"
    ).unionByName(
        long_values.selectExpr("pos", "'value' AS kind", "v AS key", f"{DIGEST.format('v')} AS id", "n", "f")
    )
    # What is left of a column's rows are the values seen once.
    rest = counts.selectExpr("pos", "n", "f").unionByName(values.selectExpr("pos", "-n AS n", "-f AS f"))
    lone = rest.groupBy("pos").agg(F.expr("sum(n) AS n"), F.expr("sum(f) AS f")).where("n > 0")
    return values.selectExpr("pos", "kind", "key", "id", "1L AS n_values", "n", "f").unionByName(
        lone.selectExpr(
            "pos", "'unique' AS kind", "CAST(NULL AS STRING) AS key", "CAST(NULL AS STRING) AS id",
            "n AS n_values", "n", "f",
        )
    )


def _place(digest: str) -> str:
    """Where a digest stands in the bitmap, from 1 on."""
    return f"CAST(conv(substring({digest}, 1, 7), 16, 10) AS BIGINT) % {BITS} + 1"


def _bitmap(digests: DataFrame) -> DataFrame:
    """The places of digests: at most ``BITS / 32768`` rows of 4 KB."""
    return (
        digests.selectExpr(f"{_place('v')} AS _bit")
        .groupBy(F.expr("bitmap_bucket_number(_bit) AS _bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_bit)) AS _map"))
    )


def seen_compared(
    base: DataFrame, columns: Mapping[int, str], selection: Selection, baseline: Baseline
) -> DataFrame:
    """As ``seen_values``; of columns asked before only the filtered rows are counted."""
    known = baseline.known("values", columns)
    fresh = {p: c for p, c in columns.items() if p not in known}
    parts = []
    if fresh:
        parts.append(baseline.keep("values", fresh, seen_values(base, fresh, selection)))
    free = {p: c for p, c in known.items() if not selection.excluding(c).clauses}
    if free:
        parts.append(baseline.rows("values", free, *NAMES[1:-1], "n AS f"))
    asked = {p: c for p, c in known.items() if p not in free}
    if asked:
        parts.append(_updated(base, asked, selection, baseline))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _updated(base, columns, selection, baseline) -> DataFrame:
    texts = text_values(base, columns)
    digests = {p: (c, digest_sql(v)) for p, (c, v) in texts.items()}
    found = long_counts(base, digests, selection, "id", filtered_only=True)
    kept = baseline.rows("values", columns, *NAMES[1:-1], "0L AS f")
    blank = "CAST(NULL AS STRING) AS kind", "CAST(NULL AS STRING) AS key"
    found = found.selectExpr("pos", *blank, "id", "0L AS n_values", "0L AS n", "n AS f")
    met = kept.where("kind <> 'unique'").unionByName(found)
    met = met.groupBy("pos", "id").agg(
        *[F.expr(f"max({c}) AS {c}") for c in ("kind", "key")], *[F.expr(f"sum({c}) AS {c}") for c in NAMES[4:]]
    )
    # A value without a kept row was seen once at most.
    met = met.selectExpr("pos", "coalesce(kind, 'unique') AS kind", "key", "CASE WHEN kind IS NOT NULL THEN id END AS id", *NAMES[4:])
    out = met.unionByName(kept.where("kind = 'unique'"))
    return out.groupBy(*NAMES[:4]).agg(*[F.expr(f"sum({c}) AS {c}") for c in NAMES[4:]])
