"""Arrow IPC streams as source and sink."""

from __future__ import annotations

from collections.abc import Iterable
from typing import BinaryIO

import pyarrow as pa

from plumbframe.errors import SinkError, SourceError
from plumbframe.plans.nodes import SourceRef
from plumbframe.sources.binding import SinkReceipt, SourceBinding, table_binding
from plumbframe.table import Table
from plumbframe.types import BOOL, FLOAT32, FLOAT64, INT32, INT64, TIMESTAMP, UTF8, DataType, Field, Schema, TimeUnit

_BACK: dict[pa.DataType, DataType] = {pa.bool_(): BOOL, pa.int32(): INT32, pa.int64(): INT64, pa.float32(): FLOAT32, pa.float64(): FLOAT64, pa.string(): UTF8, pa.large_string(): UTF8, pa.timestamp("us"): TIMESTAMP}


def schema_of(arrow: pa.Schema) -> Schema:
    out = []
    for f in arrow:
        t = _BACK.get(f.type.value_type if pa.types.is_dictionary(f.type) else f.type)
        if t is None:
            raise SourceError("SchemaMismatch", f"column '{f.name}' has Arrow type {f.type}, which isn't in this algebra")
        out.append(Field(f.name, t, f.nullable))
    return Schema(out)


def read_table(data: bytes, schema: Schema | None = None) -> Table:
    try:
        with pa.ipc.open_stream(data) as reader:
            found = reader.read_all()
    except pa.ArrowInvalid as e:
        raise SourceError("Read", "the bytes are no Arrow stream") from e
    have = schema_of(found.schema)
    if schema is not None and (issues := schema.issues(have)):
        raise SourceError("SchemaMismatch", "; ".join(i.message for i in issues), issues=issues)
    for f, c in zip(have, found.columns, strict=True):
        if not f.nullable and c.null_count:
            raise SourceError("Storage", f"required column '{f.name}' contains null")
    plain = pa.Table.from_arrays([c.cast(f.dtype.to_arrow()) for f, c in zip(have, found.columns, strict=True)], schema=have.to_arrow())
    return Table(plain, have)


def arrow_ipc_binding(data: bytes, schema: Schema | None = None, ref: SourceRef | None = None) -> SourceBinding:
    """The rows of an Arrow IPC stream, taken when the binding is made."""
    return table_binding(read_table(data, schema), ref)


class ArrowSink:
    """A sink that writes batches as an Arrow IPC stream into an open binary file."""

    def __init__(self, out: BinaryIO):
        self.out = out

    def write(self, schema: Schema, batches: Iterable[Table]) -> SinkReceipt:
        rows = parts = 0
        counted = pa.PythonFile(self.out, "w")
        with pa.ipc.new_stream(counted, schema.to_arrow()) as writer:
            for t in batches:
                writer.write_table(t.data.cast(schema.to_arrow()))
                rows, parts = rows + len(t), parts + 1
        return SinkReceipt(rows, parts, counted.tell())


def arrow_bytes(table: Table) -> bytes:
    """A table as an Arrow IPC stream; timestamps must be in microseconds."""
    for f in table.schema:
        if f.dtype.name == "Timestamp" and f.dtype.unit is not TimeUnit.MICROSECOND:
            raise SinkError("InvalidRequest", f"column '{f.name}' is a timestamp of another unit than microseconds")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema.to_arrow()) as writer:
        writer.write_table(table.data.cast(table.schema.to_arrow()))
    return sink.getvalue().to_pybytes()


