"""Arrow IPC files, read and written by the executors, by path.

Reading opens each file where it lies and takes single record batches, so a
file is decoded by many tasks and no file passes through a row. Writing gives
one file per task and a manifest of those that count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyscope.sources.arrow import plain_batch, spark_schema

ARROW_MAGIC = b"ARROW1"
MANIFEST = "_manifest"

# Schemes of Hadoop paths and the names Arrow has for them.
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _split(path: str) -> tuple[str, str]:
    scheme, colon, rest = path.partition(":")
    return (scheme, rest) if colon and scheme.isalnum() else ("", path)


def opened_by_path(path: str) -> bool:
    """Whether Arrow itself can open such paths."""
    return _split(path)[0] in SCHEMES


def located(path: str) -> tuple[fs.FileSystem, str]:
    scheme, rest = _split(path)
    if SCHEMES[scheme] == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme else rest
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


@lru_cache(maxsize=4)
def reader_of(path: str) -> pa.ipc.RecordBatchFileReader:
    """The open file; its footer tells where the record batches are."""
    system, name = located(path)
    stream = system.open_input_file(name)
    if stream.read_at(len(ARROW_MAGIC), 0) != ARROW_MAGIC:
        raise ValueError(f"not an Arrow IPC file: {path}")
    return pa.ipc.open_file(stream)


def read_arrow_paths(files: DataFrame) -> DataFrame:
    """The rows of Arrow IPC files; ``files`` has their ``path``.

    All share the schema of the first one by path; a file with another schema
    fails the job. A record batch is the smallest piece of work.
    """
    first = files.agg(F.min("path").alias("path"))
    found = first.where("path IS NOT NULL").mapInArrow(_schemas, "schema binary").head()
    if found is None:
        raise ValueError("there are no Arrow files")
    arrow_schema = pa.ipc.read_schema(pa.py_buffer(bytes(found["schema"])))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = reader_of(path)
                if not reader.schema.equals(arrow_schema):
                    raise ValueError("Arrow files differ in schema")
                if i >= 0:
                    yield plain_batch(reader.get_batch(i))

    pieces = files.select("path").mapInArrow(_pieces, "path string, i int")
    # A given number of partitions, so that these tiny rows are not put together again.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, "path", "i").sortWithinPartitions("path", "i").mapInArrow(decoded, spark_schema(arrow_schema))


def _schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [reader_of(p.as_py()).schema.serialize().to_pybytes() for p in batch.column(0)]
        yield pa.record_batch([pa.array(found, pa.binary())], ["schema"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per record batch; a file without any has one with -1, so that its schema is looked at."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            numbers = list(range(reader_of(path).num_record_batches)) or [-1]
            yield pa.record_batch([pa.array([path] * len(numbers), pa.string()), pa.array(numbers, pa.int32())], ["path", "i"])


def write_arrow(df: DataFrame, folder: str) -> None:
    """Write ``df`` as Arrow IPC files, one per task, with a manifest of path, rows and bytes.

    The manifest is a result of the same tasks: a file of a task that failed or
    ran twice is in the folder, but not in the manifest.
    """
    if not opened_by_path(folder):
        raise ValueError(f"Arrow cannot write to {folder!r}; use write(df, path)")
    schema = to_arrow_schema(df.schema)
    data = f"{folder.rstrip('/')}/data"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{data}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrow"
        system, name = located(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        rows = 0
        with system.open_output_stream(name) as sink, pa.ipc.new_file(sink, schema) as writer:
            for batch in batches:
                columns = [c.cast(f.type, safe=False) for c, f in zip(batch.columns, schema, strict=True)]
                writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
                rows += batch.num_rows
        size = system.get_file_info(name).size
        yield pa.record_batch([pa.array([path]), pa.array([rows]), pa.array([size], pa.int64())], ["path", "rows", "bytes"])

    row, manifest = "path string, rows long, bytes long", f"{folder.rstrip('/')}/{MANIFEST}"
    df.mapInArrow(written, row).write.json(manifest)
    # Rows known to be none are given to no task; one file still has their schema.
    if df.sparkSession.read.schema(row).json(manifest).isEmpty():
        one = df.sparkSession.range(0, 1, 1, 1)
        one.mapInArrow(lambda batches: written(b for b in batches if not b.num_rows), row).write.mode("append").json(manifest)


def read_arrow_result(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that ``write_arrow`` wrote."""
    manifest = spark.read.schema("path string, rows long, bytes long").json(f"{folder.rstrip('/')}/{MANIFEST}")
    return read_arrow_paths(manifest)
