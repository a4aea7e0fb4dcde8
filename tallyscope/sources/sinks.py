"""Result forms: Arrow, JSON, files and tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyscope.sources.arrow_files import read_arrow_result, write_arrow  # noqa: F401


def to_arrow(df: DataFrame) -> pa.Table:
    """A bounded result (a page, a histogram) as an Arrow table on the driver."""
    return df.toArrow()


def to_ipc(df: DataFrame) -> bytes:
    """A bounded result as an uncompressed Arrow IPC file."""
    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def json_lines(df: DataFrame) -> DataFrame:
    """``(record)``: each row as one JSON object, NULL fields included."""
    return df.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false')) AS record")


def json_records(df: DataFrame) -> Iterator[dict]:
    """Rows as Python records, one partition at a time."""
    for row in json_lines(df).toLocalIterator(prefetchPartitions=True):
        yield json.loads(row["record"])


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a result of any size from the executors."""
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    elif fmt == "arrow":
        write_arrow(df, path)
    elif fmt in ("csv", "tsv"):
        sep = "\t" if fmt == "tsv" else ","
        writer.csv(path, header=True, sep=sep, quote='"', escape='"')
    else:
        raise ValueError(f"cannot write {fmt!r}")


def execute(spark: SparkSession, statement: str) -> None:
    """Run a statement for its effect."""
    spark.sql(statement)


def save_table(df: DataFrame, name: str) -> None:
    """Create or replace a catalog table with a result."""
    df.write.mode("overwrite").saveAsTable(name)
