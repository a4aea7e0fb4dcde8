"""File sources: Parquet, CSV, TSV, JSON and folders of Arrow IPC files."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.sqltext import quote_name, string_literal, type_ddl
from tallyscope.sources.arrow import plain_batch, spark_schema
from tallyscope.sources.arrow_files import ARROW_MAGIC, opened_by_path, read_arrow_paths

# File extensions and the formats they stand for.
EXTENSIONS = {
    "parquet": "parquet",
    "pq": "parquet",
    "csv": "csv",
    "tsv": "tsv",
    "json": "json",
    "arrow": "arrow",
    "feather": "arrow",
}
FORMATS = ("parquet", "csv", "tsv", "json", "arrow")
TEXT_FORMATS = ("csv", "tsv", "json")

def resolve_format(path: str, fmt: str | None = None) -> str:
    """The explicit format if there is one, else by extension; never a guess."""
    if fmt is not None:
        if fmt not in FORMATS:
            raise ValueError(f"unsupported file type {fmt!r}; known types are {FORMATS}")
        return fmt
    name = urlsplit(path).path.rstrip("/").rsplit("/", 1)[-1]
    _, dot, extension = name.rpartition(".")
    found = EXTENSIONS.get(extension.lower()) if dot else None
    if found is None:
        raise ValueError(f"cannot tell the file type of {path!r}; give fmt=")
    return found


@dataclass(frozen=True)
class FileSource:
    """A path with its resolved format; kept so that SQL can name the file."""

    path: str
    fmt: str
    multiline: bool = False
    header: bool = True
    sep: str | None = None
    #: JSON files of a folder that hold an array, beside others that hold lines.
    arrays: tuple[str, ...] = ()
    lines: tuple[str, ...] = ()
    #: The schema the file was opened with, as DDL, if one was given.
    schema: str | None = None

    def options(self) -> dict[str, str]:
        """A bad record raises; so does a CSV file whose header names other columns, or these in another order."""
        out = {"multiLine": "true"} if self.multiline else {}
        if self.fmt in TEXT_FORMATS:
            out["mode"] = "FAILFAST"
        if self.fmt in ("csv", "tsv"):
            out |= {"header": str(self.header).lower(), "inferSchema": "true", "quote": '"', "escape": '"', "enforceSchema": "false"}
            if self.schema:
                out["inferSchema"] = "false"
        if self.sep or self.fmt == "tsv":
            out["sep"] = self.sep or "\t"
        return out

    def spark_format(self) -> str:
        return "csv" if self.fmt == "tsv" else self.fmt

    def from_sql(self) -> str | None:
        """What to write after FROM, when the file can be named in place."""
        return f"parquet.{quote_name(self.path)}" if self.fmt == "parquet" else None

    def view_sql(self, table_sql: str, found: T.StructType) -> str | None:
        """Statements that make the file readable under a name, with the columns ``found``."""
        if self.fmt not in TEXT_FORMATS:
            return None
        if not self.arrays:
            return self._one_view(table_sql, self.path, self.options(), self.schema)
        # Files of both kinds: a view of each, with all columns, and one over them.
        columns, name = schema_ddl(found), table_sql.replace("`", "")
        kinds = (("arrays", self.arrays, {"multiLine": "true"}), ("lines", self.lines, {}))
        views = [
            self._one_view(quote_name(f"{name}_{kind}"), _glob(files), {**more, "mode": "FAILFAST"}, columns)
            for kind, files, more in kinds
        ]
        both = " UNION ALL ".join(f"SELECT * FROM {quote_name(f'{name}_{kind}')}" for kind, *_ in kinds)
        return ";\n".join([*views, f"CREATE OR REPLACE TEMPORARY VIEW {table_sql} AS {both}"])

    def _one_view(self, name: str, path: str, options: dict[str, str], columns: str | None) -> str:
        listed = ", ".join(f"{k} {string_literal(v)}" for k, v in {"path": path, **options}.items())
        typed = f" ({columns})" if columns else ""
        return f"CREATE OR REPLACE TEMPORARY VIEW {name}{typed} USING {self.spark_format()} OPTIONS ({listed})"


def schema_ddl(schema: T.StructType) -> str:
    """Columns and types as they are written in a statement."""
    return ", ".join(f"{quote_name(f.name)} {type_ddl(f.dataType)}" for f in schema.fields)


def _glob(files: tuple[str, ...]) -> str:
    """One path for several files, with the characters escaped that mean something in a glob."""
    escaped = [re.sub(r"([{}\[\]*?,\\])", r"\\\1", f) for f in files]
    return escaped[0] if len(escaped) == 1 else "{" + ",".join(escaped) + "}"


def file_source(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    multiline: bool | None = None,
    header: bool = True,
    sep: str | None = None,
) -> FileSource:
    """``multiline`` lets CSV fields hold line breaks; for JSON it is found out, for each file of a folder."""
    resolved = resolve_format(path, fmt)
    arrays, lines = (), ()
    if multiline is None and resolved == "json":
        arrays, lines = _json_kinds(spark, path)
        multiline = bool(arrays)
        if not (arrays and lines):
            arrays, lines = (), ()
    return FileSource(path, resolved, bool(multiline), header, sep, arrays, lines)


def read_file(
    spark: SparkSession, source: FileSource, schema: T.StructType | str | None = None
) -> DataFrame:
    """Lazy scan. Without ``schema`` a text file is read once more to infer it."""
    if source.fmt == "arrow":
        return read_arrow_files(spark, source.path)
    if source.arrays:
        parts = [
            read_file(spark, FileSource(files, "json", multiline), schema)
            for files, multiline in ((list(source.arrays), True), (list(source.lines), False))
        ]
        return parts[0].unionByName(parts[1], allowMissingColumns=True)
    reader = spark.read.format(source.spark_format()).options(**source.options())
    if schema is not None:
        reader = reader.schema(schema)
        if source.fmt in ("csv", "tsv"):
            reader = reader.option("inferSchema", "false")
    return reader.load(source.path)


def open_file(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    keep: bool = True,
    multiline: bool | None = None,
    header: bool = True,
    sep: str | None = None,
) -> tuple[DataFrame, FileSource]:
    """Parquet and Arrow stay lazy; text is parsed once and kept, unless ``keep`` is false."""
    source = file_source(spark, path, fmt, multiline, header, sep)
    if schema is not None:
        text = schema if isinstance(schema, str) else schema_ddl(schema)
        source = replace(source, schema=text)
    df = read_file(spark, source, schema)
    if keep and source.fmt in TEXT_FORMATS:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, source


def _json_kinds(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The files whose first non-blank character is ``[``, and the others that are not blank.

    The first split of each file decides, so the list is as long as that of the files, which the driver has anyway.
    """
    start = F.substring(F.regexp_replace("value", r"^[\s\uFEFF]+", ""), 1, 1).alias("c")
    heads = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", start)
    heads = heads.where("c <> '' AND file_block_start = 0")
    firsts = heads.groupBy("file_path").agg(F.first("c").alias("c")).collect()
    arrays = tuple(sorted(r["file_path"] for r in firsts if r["c"] == "["))
    return arrays, tuple(sorted(r["file_path"] for r in firsts if r["c"] != "["))


def read_arrow_files(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, decoded by record batch.

    Where Arrow cannot open a path (a store that only Hadoop knows), each file
    is read whole instead, up to Spark's limit of 2 GB for a value.
    """
    if opened_by_path(path):
        return read_arrow_paths(spark.read.format("binaryFile").load(path).select("path"))
    return _read_whole_files(spark, path)


def _read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").agg(F.min("path").alias("path")).head()["path"]
    if first is None:
        raise ValueError(f"no Arrow files in {path!r}")

    def describe(batches):
        # Only the schema leaves the executors.
        for batch in batches:
            found = [_open_ipc(c.as_buffer()).schema.serialize().to_pybytes() for c in batch.column(0)]
            yield pa.record_batch([pa.array(found, pa.binary())], ["schema"])

    one = spark.read.format("binaryFile").load(first).select("content")
    found = one.mapInArrow(describe, "schema binary").head()["schema"]
    arrow_schema = pa.ipc.read_schema(pa.py_buffer(bytes(found)))
    schema = spark_schema(arrow_schema)

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                # as_buffer() shares the bytes of the batch, no copy is made.
                reader = _open_ipc(content.as_buffer())
                if not reader.schema.equals(arrow_schema):
                    raise ValueError("Arrow files differ in schema")
                for i in range(reader.num_record_batches):
                    yield plain_batch(reader.get_batch(i))

    return files.select("content").mapInArrow(decode, schema)


def is_arrow_ipc(data: object) -> bool:
    return isinstance(data, (bytes, bytearray, memoryview)) and bytes(data[:6]) == ARROW_MAGIC


def _open_ipc(data) -> pa.ipc.RecordBatchFileReader:
    buffer = data if isinstance(data, pa.Buffer) else pa.py_buffer(data)
    if buffer[: len(ARROW_MAGIC)].to_pybytes() != ARROW_MAGIC:
        raise ValueError("not an Arrow IPC file")
    return pa.ipc.open_file(buffer)
