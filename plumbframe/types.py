"""Data types and exact, ordered schemas."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum

import pyarrow as pa
from pyspark.sql import types as T

from plumbframe.errors import SchemaError


class TimeUnit(Enum):
    SECOND = "Second"
    MILLISECOND = "Millisecond"
    MICROSECOND = "Microsecond"
    NANOSECOND = "Nanosecond"


@dataclass(frozen=True)
class DataType:
    """One of the closed set below; unit is set for timestamps only."""

    name: str
    unit: TimeUnit | None = None

    def __repr__(self) -> str:
        return f"Timestamp({self.unit.value})" if self.name == "Timestamp" and self.unit else self.name

    __str__ = __repr__

    @property
    def is_integer(self) -> bool:
        return self.name in ("Int32", "Int64")

    @property
    def is_floating(self) -> bool:
        return self.name in ("Float32", "Float64")

    @property
    def is_numeric(self) -> bool:
        return self.is_integer or self.is_floating

    def to_spark(self) -> T.DataType:
        """Timestamps of other units than microseconds are whole numbers of their unit."""
        if self.name == "Timestamp":
            return T.TimestampNTZType() if self.unit is TimeUnit.MICROSECOND else T.LongType()
        return _SPARK[self.name]()

    def to_arrow(self) -> pa.DataType:
        if self.name == "Timestamp":
            return pa.timestamp("us") if self.unit is TimeUnit.MICROSECOND else pa.int64()
        return _ARROW[self.name]


_SPARK = {"Bool": T.BooleanType, "Int32": T.IntegerType, "Int64": T.LongType, "Float32": T.FloatType, "Float64": T.DoubleType, "Utf8": T.StringType}
_ARROW = {"Bool": pa.bool_(), "Int32": pa.int32(), "Int64": pa.int64(), "Float32": pa.float32(), "Float64": pa.float64(), "Utf8": pa.string()}

BOOL, INT32, INT64, FLOAT32, FLOAT64, UTF8 = (DataType(n) for n in ("Bool", "Int32", "Int64", "Float32", "Float64", "Utf8"))


def timestamp(unit: TimeUnit | None = TimeUnit.MICROSECOND) -> DataType:
    return DataType("Timestamp", unit)


TIMESTAMP = timestamp()


@dataclass(frozen=True)
class Field:
    name: str
    dtype: DataType
    nullable: bool = False


@dataclass(frozen=True)
class BindingIssue:
    """How one field of a schema differs from what is expected."""

    kind: str  # FieldCount, FieldName, FieldType or FieldNullability
    index: int
    expected: object
    actual: object

    @property
    def message(self) -> str:
        if self.kind == "FieldCount":
            return f"{self.actual} fields where {self.expected} are expected"
        what = {"FieldName": "name", "FieldType": "type", "FieldNullability": "nullability"}[self.kind]
        return f"field {self.index}: {what} {self.actual}, expected {self.expected}"


class Schema:
    """Ordered fields of unique names that aren't blank."""

    __slots__ = ("_by_name", "fields")

    def __init__(self, fields: Iterable[Field]):
        if fields is None:
            raise SchemaError("NullFields", "there are no fields")
        fields = tuple(fields)
        for i, f in enumerate(fields):
            if f is None:
                raise SchemaError("NullField", f"field {i} is null", index=i)
            if f.name is None:
                raise SchemaError("NullFieldName", f"field {i} has no name", index=i)
            if f.dtype is None:
                raise SchemaError("NullFieldType", f"field {i} has no type", index=i)
            if f.dtype.name == "Timestamp" and f.dtype.unit is None:
                raise SchemaError("NullTimestampUnit", f"timestamp field {i} has no unit", index=i)
            if not f.name.strip():
                raise SchemaError("EmptyFieldName", f"field {i} has a blank name", index=i)
        for name, n in Counter(f.name for f in fields).items():
            if n > 1:
                raise SchemaError("DuplicateFieldName", f"field '{name}' occurs {n} times", name=name)
        self.fields = fields
        self._by_name = {f.name: i for i, f in enumerate(fields)}

    @classmethod
    def of(cls, **fields: DataType | tuple[DataType, bool]) -> Schema:
        """Schema.of(id=INT32, score=(FLOAT64, True)): True makes a field nullable."""
        return cls(Field(n, *(t if isinstance(t, tuple) else (t, False))) for n, t in fields.items())

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields)

    def index(self, name: str) -> int | None:
        return self._by_name.get(name)

    def field(self, name: str) -> Field | None:
        i = self._by_name.get(name)
        return None if i is None else self.fields[i]

    def __len__(self) -> int:
        return len(self.fields)

    def __iter__(self):
        return iter(self.fields)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.fields == other.fields

    def __hash__(self) -> int:
        return hash(self.fields)

    def __repr__(self) -> str:
        return "Schema(" + ", ".join(f"{f.name}: {f.dtype}{'?' if f.nullable else ''}" for f in self.fields) + ")"

    def issues(self, actual: Schema) -> list[BindingIssue]:
        """All that keeps actual from being exactly this schema."""
        if len(self) != len(actual):
            return [BindingIssue("FieldCount", -1, len(self), len(actual))]
        out = []
        for i, (e, a) in enumerate(zip(self, actual, strict=True)):
            out += [BindingIssue(kind, i, x, y) for kind, x, y in (("FieldName", e.name, a.name), ("FieldType", e.dtype, a.dtype), ("FieldNullability", e.nullable, a.nullable)) if x != y]
        return out

    def to_spark(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dtype.to_spark(), f.nullable, {"time_unit": f.dtype.unit.value} if f.dtype.unit else {}) for f in self.fields])

    def to_arrow(self) -> pa.Schema:
        return pa.schema([pa.field(f.name, f.dtype.to_arrow(), f.nullable) for f in self.fields])

    @classmethod
    def from_spark(cls, struct: T.StructType) -> Schema:
        back: dict[type, DataType] = {T.BooleanType: BOOL, T.IntegerType: INT32, T.LongType: INT64, T.FloatType: FLOAT32, T.DoubleType: FLOAT64, T.StringType: UTF8, T.TimestampNTZType: TIMESTAMP}
        out = []
        for i, f in enumerate(struct.fields):
            t = back.get(type(f.dataType))
            if t is None:
                raise SchemaError("UnsupportedFieldType", f"field {i} ('{f.name}') has type {f.dataType.simpleString()}, which isn't in this algebra", index=i)
            unit = f.metadata.get("time_unit") if f.metadata else None
            out.append(Field(f.name, timestamp(TimeUnit(unit)) if t is INT64 and unit else t, f.nullable))
        return cls(out)
