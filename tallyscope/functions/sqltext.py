"""Spark SQL spellings of names and values.

Every predicate of the package is written once, as SQL text. The same text
becomes a DataFrame filter through ``F.expr`` and part of the exported query,
so the two cannot drift apart.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

from pyspark.sql import types as T


def quote_name(name: str) -> str:
    """Backtick-quote one column name, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def quote_table(name: str) -> str:
    """Quote a table name that may be qualified (``catalog.schema.table``)."""
    if "`" in name:
        return name
    return ".".join(quote_name(part) for part in name.split("."))


def string_literal(text: str) -> str:
    body = text.replace("\\", "\\\\").replace("'", "\\'")
    # spark.sql() substitutes ${...} in its text, also inside string literals.
    body = body.replace("${", "\\u0024{")
    return f"'{body}'"


def double_literal(value: float) -> str:
    value = float(value)
    if math.isnan(value):
        return "double('NaN')"
    if math.isinf(value):
        return "double('Infinity')" if value > 0 else "double('-Infinity')"
    return f"{value!r}D"


def _timestamp_literal(value: dt.datetime, dtype: T.DataType | None) -> str:
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    text = value.isoformat(sep=" ")
    if isinstance(dtype, T.TimestampType):
        return f"TIMESTAMP'{text} UTC'"
    return f"TIMESTAMP_NTZ'{text}'"


def literal(value: object, dtype: T.DataType | None = None) -> str:
    """SQL literal for a Python value; ``dtype`` is the column it meets.

    Date-times without a zone are read as UTC.
    """
    if isinstance(dtype, (T.ArrayType, T.StructType)):
        return _nested_literal(value, dtype)
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        if -(2**31) <= value < 2**31:
            return str(value)
        if -(2**63) < value < 2**63:
            return f"{value}L"
        return f"{value}BD"
    if isinstance(value, float):
        return double_literal(value)
    if isinstance(value, decimal.Decimal):
        return f"{value:f}BD"
    if isinstance(value, str):
        return string_literal(value)
    if isinstance(value, dt.datetime):
        return _timestamp_literal(value, dtype)
    if isinstance(value, dt.date):
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return _timestamp_literal(dt.datetime(value.year, value.month, value.day), dtype)
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def _nested_literal(value: object, dtype: T.DataType) -> str:
    """An array or struct with all its types, also where it is empty or holds NULL."""
    if value is None:
        return f"CAST(NULL AS {type_ddl(dtype)})"
    if isinstance(dtype, T.ArrayType):
        items = [_nested_literal(x, dtype.elementType) for x in value]
        return f"array({', '.join(items)})" if items else f"CAST(array() AS {type_ddl(dtype)})"
    if isinstance(dtype, T.StructType):
        pairs = [f"{string_literal(f.name)}, {_nested_literal(x, f.dataType)}" for f, x in zip(dtype.fields, value, strict=True)]
        return f"named_struct({', '.join(pairs)})"
    return f"CAST({literal(value, dtype)} AS {type_ddl(dtype)})"


def type_ddl(dtype: T.DataType) -> str:
    """A type as it is written in a statement, field names quoted."""
    if isinstance(dtype, T.ArrayType):
        return f"ARRAY<{type_ddl(dtype.elementType)}>"
    if isinstance(dtype, T.MapType):
        return f"MAP<{type_ddl(dtype.keyType)}, {type_ddl(dtype.valueType)}>"
    if isinstance(dtype, T.StructType):
        return f"STRUCT<{', '.join(f'{quote_name(f.name)}: {type_ddl(f.dataType)}' for f in dtype.fields)}>"
    return dtype.simpleString().upper()
