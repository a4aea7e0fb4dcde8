"""Display text of values, built from Spark functions only.

``preview`` turns every column of a table into the text a table view shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.columns import col, holds_timestamps

# How much of a cell is shown.
LIST_ITEMS = 5
BINARY_BYTES = 32

# Units of integer time and duration values, in nanoseconds.
UNIT_NANOS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
_DAY_NANOS = 86_400_000_000_000


def _formatted(c: Column, pattern: str) -> Column:
    return F.call_function("format_number", c, F.lit(pattern))


def number_text(c: Column, dtype: T.DataType) -> Column:
    """English grouping, at most three decimals; decimals keep their scale."""
    if isinstance(dtype, T.DecimalType):
        pattern = "#,##0." + "#" * dtype.scale if dtype.scale else "#,##0"
        return _formatted(c, pattern)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        x = c.cast("double")
        shown = _formatted(F.round(x, 3), "#,##0.###")
        return F.when(F.isnan(x), "NaN").when(x == 0, "0").otherwise(shown)
    return _formatted(c, "#,##0")


def plain_number_text(c: Column) -> Column:
    """Shortest text of a double without grouping: ``0.0005``, ``1e-7``, ``12``."""
    x = c.cast("double")
    short = x.cast("string")
    size = F.abs(x)
    small = F.regexp_replace(short.cast("decimal(38,30)").cast("string"), r"0+$", "")
    large = F.regexp_replace(short.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    power = F.regexp_replace(F.regexp_replace(short, r"\.0E", "E"), r"E(\d)", r"e+$1")
    return (
        F.when(x == 0, "0")
        .when(~short.contains("E"), F.regexp_replace(short, r"\.0$", ""))
        .when((size >= 1e-6) & (size < 1), small)
        .when((size >= 1) & (size < 1e21), large)
        .otherwise(F.replace(power, F.lit("E"), F.lit("e")))
    )


def binary_text(c: Column) -> Column:
    """``b'...'``: printable bytes as they are, others as ``\\xNN``."""
    places = F.filter(
        F.sequence(F.lit(1), F.lit(BINARY_BYTES)), lambda i: i <= F.octet_length(c)
    )

    def one(i: Column) -> Column:
        digits = F.hex(F.substring(c, i, F.lit(1)))
        code = F.conv(digits, 16, 10).cast("bigint")
        return F.when(code.between(32, 126), F.char(code)).otherwise(
            F.concat(F.lit("\\x"), F.lower(digits))
        )

    more = F.when(F.octet_length(c) > BINARY_BYTES, "...").otherwise("")
    shown = F.concat(F.lit("b'"), F.array_join(F.transform(places, one), ""), more, F.lit("'"))
    return F.when(c.isNotNull(), shown)


def date_text(c: Column) -> Column:
    return c.cast("string")


def timestamp_text(c: Column, dtype: T.DataType) -> Column:
    """ISO date-time in UTC, fraction without trailing zeros."""
    if isinstance(dtype, T.TimestampType):
        c = F.timestamp_add(
            "MICROSECOND", F.unix_micros(c), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        )
    return F.replace(c.cast("string"), F.lit(" "), F.lit("T"))


def _fraction(nanos: Column) -> Column:
    """``.5`` for half a second; empty for none."""
    digits = F.lpad(nanos.cast("string"), 9, "0")
    return F.when(nanos == 0, "").otherwise(
        F.concat(F.lit("."), F.regexp_replace(digits, r"0+$", ""))
    )


def time_text(c: Column, unit: str) -> Column:
    """Time of day from an integer count of ``unit`` (s, ms, us, ns)."""
    per_day = _DAY_NANOS // UNIT_NANOS[unit]
    nanos = F.pmod(c.cast("bigint"), F.lit(per_day)) * F.lit(UNIT_NANOS[unit])
    seconds = F.floor(nanos / 1_000_000_000)

    def two(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")

    return F.concat(
        two(F.floor(seconds / 3600)), F.lit(":"),
        two(F.floor(seconds / 60) % 60), F.lit(":"),
        two(seconds % 60), _fraction(nanos % 1_000_000_000),
    )


def duration_text(c: Column, unit: str) -> Column:
    """ISO-8601 duration from an integer count of ``unit``: ``PT90000.5S``."""
    whole = F.lit(1_000_000_000 // UNIT_NANOS[unit]).cast("decimal(20,0)")
    size = F.abs(c.cast("decimal(20,0)"))
    seconds = F.floor(size / whole).cast("bigint")
    rest = (size - seconds * whole).cast("bigint") * F.lit(UNIT_NANOS[unit])
    sign = F.when(c < 0, "-").otherwise("")
    return F.concat(sign, F.lit("PT"), seconds.cast("string"), _fraction(rest), F.lit("S"))


def interval_text(c: Column, dtype: T.DataType) -> Column:
    """ISO-8601 text of Spark's interval types."""
    if isinstance(dtype, T.YearMonthIntervalType):
        c = c.cast("interval year to month")
        months = (F.extract(F.lit("YEAR"), c) * 12 + F.extract(F.lit("MONTH"), c)).cast("bigint")
        sign = F.when(months < 0, "-").otherwise("")
        size = F.abs(months)
        year, month = F.floor(size / 12).cast("bigint"), size % 12
        shown = F.concat(
            sign, F.lit("P"),
            F.when(year > 0, F.concat(year.cast("string"), F.lit("Y"))).otherwise(""),
            F.when((month > 0) | (year == 0), F.concat(month.cast("string"), F.lit("M"))).otherwise(""),
        )
        return F.when(c.isNotNull(), shown)
    c = c.cast("interval day to second")
    part = {p: F.extract(F.lit(p), c) for p in ("DAY", "HOUR", "MINUTE", "SECOND")}
    seconds = part["DAY"] * 86400 + part["HOUR"] * 3600 + part["MINUTE"] * 60
    micros = seconds.cast("bigint") * 1_000_000 + (part["SECOND"] * 1_000_000).cast("bigint")
    return duration_text(micros, "us")


def json_text(c: Column, dtype: T.DataType) -> Column:
    return F.to_json(c, {"timeZone": "UTC"}) if holds_timestamps(dtype) else F.to_json(c)


def list_text(c: Column, dtype: T.ArrayType) -> Column:
    """The first five items, then ``...``; a NULL item prints as nothing."""
    element = dtype.elementType

    def item(x: Column) -> Column:
        if isinstance(element, (T.FloatType, T.DoubleType)):
            return plain_number_text(x)
        if isinstance(element, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return json_text(x, element)
        if isinstance(element, (T.TimestampType, T.TimestampNTZType)):
            return timestamp_text(x, element)
        if isinstance(element, T.BinaryType):
            return binary_text(x)
        return x.cast("string")

    shown = F.array_join(F.transform(F.slice(c, 1, LIST_ITEMS), item), ", ", "")
    more = F.when(F.size(c) > LIST_ITEMS, ", ...").otherwise("")
    return F.concat(F.lit("["), shown, more, F.lit("]"))


def value_text(c: Column, dtype: T.DataType) -> Column:
    """Display text of one value; NULL reads ``null``."""
    if isinstance(dtype, T.NumericType):
        out = number_text(c, dtype)
    elif isinstance(dtype, T.BinaryType):
        out = binary_text(c)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        out = timestamp_text(c, dtype)
    elif isinstance(dtype, T.ArrayType):
        out = list_text(c, dtype)
    elif isinstance(dtype, (T.MapType, T.StructType, T.VariantType)):
        out = json_text(c, dtype)
    elif isinstance(dtype, (T.YearMonthIntervalType, T.DayTimeIntervalType)):
        out = interval_text(c, dtype)
    elif isinstance(dtype, T.DateType):
        out = date_text(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("null"))


def preview(df: DataFrame) -> DataFrame:
    """Every column as display text, under its own name."""
    return df.select(
        *[value_text(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def percent_text(fraction: Column) -> Column:
    """No decimals from 10 %, one from 1 %, two below."""
    hundred = fraction * 100

    def shown(digits: int) -> Column:
        return F.concat(F.format_string(f"%.{digits}f", F.round(hundred, digits)), F.lit("%"))

    return (
        F.when(fraction >= 0.1, shown(0))
        .when(fraction >= 0.01, shown(1))
        .when(fraction.isNotNull(), shown(2))
    )
