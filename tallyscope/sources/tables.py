"""Tables, queries and in-memory data as DataFrames, and their names."""

from __future__ import annotations

import sys

import pyarrow as pa
import pyarrow.interchange
from pyspark.sql import DataFrame, SparkSession

from tallyscope.functions.sqltext import quote_table
from tallyscope.sources.arrow import plain_table, spark_schema
from tallyscope.sources.files import is_arrow_ipc


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(quote_table(name))


def read_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def from_data(spark: SparkSession, data: object) -> DataFrame:
    """A DataFrame from what a notebook user holds.

    In order: a Spark DataFrame as it is; a polars frame; an object with an
    Arrow C stream; the bytes of an Arrow IPC file; an object with the
    dataframe protocol. Such data is already in this process; large data
    belongs in files.
    """
    if isinstance(data, DataFrame):
        return data
    table = _arrow_table(data)
    return spark.createDataFrame(plain_table(table), schema=spark_schema(table.schema))


def _arrow_table(data: object) -> pa.Table:
    polars = sys.modules.get("polars")
    if polars is not None and isinstance(data, polars.DataFrame):
        return data.to_arrow()
    if isinstance(data, pa.Table):
        return data
    if hasattr(data, "__arrow_c_stream__"):
        return pa.table(data)
    if is_arrow_ipc(data):
        return pa.ipc.open_file(pa.py_buffer(data)).read_all()
    if callable(getattr(data, "__dataframe__", None)):
        for method in ("arrow", "to_arrow", "to_arrow_table"):
            convert = getattr(data, method, None)
            table = convert() if callable(convert) else None
            if isinstance(table, pa.Table):
                return table
        return pyarrow.interchange.from_dataframe(data)
    raise ValueError(
        "expected a Spark DataFrame, a dataframe-like object, an Arrow object or "
        f"the bytes of an Arrow IPC file, not {type(data).__name__}"
    )


def register(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` readable as ``name``, replacing what had the name."""
    df.createOrReplaceTempView(name)
    return df


def free_name(spark: SparkSession, stem: str = "df") -> str:
    """``stem``, or with the first number that no view has yet."""
    name, n = stem, 1
    while spark.catalog.tableExists(name):
        n += 1
        name = f"{stem}_{n}"
    return name


def column_names(spark: SparkSession, table: str) -> list[str]:
    return read_table(spark, table).columns
