"""Arrow data in the types Spark reads: encodings are decoded, types widened."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

# Arrow types without a Spark twin, and what they are read as.
# Unsigned integers get the next wider signed type; times of day become
# microseconds since midnight.
READ_AS = {
    pa.uint8(): pa.int16(),
    pa.uint16(): pa.int32(),
    pa.uint32(): pa.int64(),
    pa.uint64(): pa.decimal128(20, 0),
    pa.float16(): pa.float32(),
    pa.date64(): pa.date32(),
    pa.time32("s"): pa.int64(),
    pa.time32("ms"): pa.int64(),
    pa.time64("us"): pa.int64(),
    pa.time64("ns"): pa.int64(),
    pa.large_string(): pa.string(),
    pa.string_view(): pa.string(),
    pa.large_binary(): pa.binary(),
    pa.binary_view(): pa.binary(),
}


def plain_type(dtype: pa.DataType) -> pa.DataType:
    """The Arrow type a column is turned into before Spark sees it."""
    if dtype in READ_AS:
        return READ_AS[dtype]
    if pa.types.is_dictionary(dtype) or pa.types.is_run_end_encoded(dtype):
        return plain_type(dtype.value_type)
    if pa.types.is_fixed_size_binary(dtype):
        return pa.binary()
    if pa.types.is_duration(dtype):
        return pa.duration("us")
    if pa.types.is_timestamp(dtype):
        return pa.timestamp("us", dtype.tz)
    if pa.types.is_decimal256(dtype) and dtype.precision <= 38:
        return pa.decimal128(dtype.precision, dtype.scale)
    if pa.types.is_struct(dtype):
        return pa.struct([dtype.field(i).with_type(plain_type(dtype.field(i).type)) for i in range(dtype.num_fields)])
    if pa.types.is_map(dtype):
        return pa.map_(plain_type(dtype.key_type), plain_type(dtype.item_type))
    if hasattr(dtype, "value_field"):  # the list types
        return pa.list_(dtype.value_field.with_type(plain_type(dtype.value_type)))
    return dtype


def plain_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([f.with_type(plain_type(f.type)) for f in schema])


def spark_schema(schema: pa.Schema) -> T.StructType:
    """Timestamps without a zone stay without one."""
    return from_arrow_schema(plain_schema(schema), prefer_timestamp_ntz=True)


def _plain_array(array: pa.Array) -> pa.Array:
    dtype = array.type
    if pa.types.is_run_end_encoded(dtype):
        return _plain_array(pc.run_end_decode(array))
    if pa.types.is_time(dtype):
        array = array.cast(pa.time64("us"), safe=False)
    # Nanoseconds are cut to microseconds, the finest Spark keeps.
    return array.cast(plain_type(dtype), safe=False)


def plain_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [_plain_array(c) for c in batch.columns], schema=plain_schema(batch.schema)
    )


def plain_table(table: pa.Table) -> pa.Table:
    batches = [plain_batch(b) for b in table.to_batches()]
    return pa.Table.from_batches(batches, schema=plain_schema(table.schema))
