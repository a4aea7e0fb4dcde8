"""Column roles, display names of types, and the text used to group values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.sqltext import quote_name

NUMBER = "number"
DATE = "date"
CATEGORY = "category"

# The display names of types follow the Arrow spelling.
TYPE_NAMES = {
    "void": "null",
    "tinyint": "int8",
    "smallint": "int16",
    "int": "int32",
    "bigint": "int64",
    "float": "float32",
    "double": "float64",
    "boolean": "bool",
    "string": "utf8",
    "binary": "binary",
    "date": "date[day]",
    "timestamp": "timestamp[tz=UTC]",
    "timestamp_ntz": "timestamp",
}


def type_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.DecimalType):
        return f"decimal({dtype.precision}, {dtype.scale})"
    if isinstance(dtype, T.ArrayType):
        return f"list[{type_name(dtype.elementType)}]"
    if isinstance(dtype, T.StructType):
        inside = ", ".join(f"{f.name}: {type_name(f.dataType)}" for f in dtype.fields)
        return f"struct<{inside}>"
    if isinstance(dtype, T.MapType):
        key, value = type_name(dtype.keyType), type_name(dtype.valueType)
        return f"map<struct<key: {key}, value: {value}>>"
    if isinstance(dtype, T.YearMonthIntervalType):
        return "interval[ym]"
    if isinstance(dtype, T.DayTimeIntervalType):
        return "duration[µs]"
    if isinstance(dtype, (T.CharType, T.VarcharType)):
        return "utf8"
    simple = dtype.simpleString()
    if simple.startswith("time("):
        return "time64[µs]"
    return TYPE_NAMES.get(simple, simple)


def role(dtype: T.DataType) -> str:
    """``number`` and ``date`` columns get histograms, the rest value counts."""
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return CATEGORY


def field(schema: T.StructType, name: str) -> T.StructField:
    for candidate in schema.fields:
        if candidate.name == name:
            return candidate
    raise ValueError(f"no column {name!r}; columns are {schema.fieldNames()}")


def col(name: str) -> Column:
    return F.col(quote_name(name))


def holds_timestamps(dtype: T.DataType) -> bool:
    """Whether the text of such values depends on a time zone."""
    if isinstance(dtype, T.ArrayType):
        return holds_timestamps(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return holds_timestamps(dtype.keyType) or holds_timestamps(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(holds_timestamps(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.TimestampType, T.VariantType))


def json_sql(value: str, dtype: T.DataType) -> str:
    """JSON with instants in UTC, whatever the session's zone."""
    return f"to_json({value}, map('timeZone', 'UTC'))" if holds_timestamps(dtype) else f"to_json({value})"


def text_sql(name: str, dtype: T.DataType) -> str:
    """The text a value is counted under, as SQL; NULL stays NULL. Instants are written in UTC."""
    quoted = quote_name(name)
    if isinstance(dtype, T.StringType):
        return quoted
    if isinstance(dtype, T.BinaryType):
        return f"hex({quoted})"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return json_sql(quoted, dtype)
    if isinstance(dtype, T.TimestampType):
        return f"CAST(timestampadd(MICROSECOND, unix_micros({quoted}), TIMESTAMP_NTZ'1970-01-01 00:00:00') AS STRING)"
    return f"CAST({quoted} AS STRING)"


def text(df: DataFrame, name: str) -> Column:
    return F.expr(text_sql(name, field(df.schema, name).dataType))


def orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(orderable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType, T.NullType))


ROLE_SCHEMA = "pos int, column string, type_name string, role string, nullable boolean"


def roles(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """One row per column, from the schema alone; no job reads the data."""
    rows = [
        (pos, f.name, type_name(f.dataType), role(f.dataType), f.nullable)
        for pos, f in enumerate(schema.fields)
    ]
    return spark.createDataFrame(rows, ROLE_SCHEMA)
