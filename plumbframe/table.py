"""Table: a collected result, read by row, cell and column, and rendered as bounded text. It has no transforms."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa

from plumbframe.errors import PlumbError, StorageError, TableReadError
from plumbframe.types import Schema, TimeUnit

ELLIPSIS = "…"


def arrow_table(rows: Iterable[object], schema: Schema) -> pa.Table:
    """Rows (tuples, mappings or dataclass instances) as columns of the schema's types."""
    columns: list[list[object]] = [[] for _ in schema]
    it = iter(rows)
    n = 0
    while True:
        try:
            r = next(it)
        except StopIteration:
            break
        except PlumbError:
            raise
        except Exception as e:
            raise TableReadError("InputFailure", f"reading row {n} failed", row=n, stage="read") from e
        cells = as_cells(r, schema, n)
        for c, v in zip(columns, cells, strict=True):
            c.append(v)
        n += 1
    out = []
    for f, c in zip(schema, columns, strict=True):
        if not f.nullable and any(v is None for v in c):
            raise StorageError("RequiredColumnContainsNull", f"required column '{f.name}' contains null", name=f.name)
        try:
            out.append(pa.array(c, f.dtype.to_arrow()))
        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as e:
            raise TableReadError("InvalidValue", f"column '{f.name}' has a value that isn't {f.dtype}", name=f.name) from e
    if not out:
        return _without_columns(n)
    return pa.Table.from_arrays(out, schema=schema.to_arrow())


def as_cells(row: object, schema: Schema, at: int = 0) -> Sequence[object]:
    if isinstance(row, Mapping):
        if set(row) != set(schema.names):
            raise TableReadError("InputFailure", f"row {at} has other names than the schema", row=at, stage="encode")
        return [row[n] for n in schema.names]
    if dataclasses.is_dataclass(row):
        return as_cells({f.name: getattr(row, f.name) for f in dataclasses.fields(row)}, schema, at)
    if len(row) != len(schema):  # type: ignore[arg-type]
        raise TableReadError("InputFailure", f"row {at} has {len(row)} values, not {len(schema)}", row=at, stage="encode")  # type: ignore[arg-type]
    return row  # type: ignore[return-value]


def _without_columns(n: int) -> pa.Table:
    """n rows of no columns."""
    return pa.table({"_": pa.nulls(n)}).select([])


class Table:
    def __init__(self, data: pa.Table, schema: Schema, row_count: int | None = None):
        if len(schema) != data.num_columns:
            raise StorageError("ColumnCount", f"{data.num_columns} columns, {len(schema)} in the schema")
        self.data, self.schema = data, schema
        self.row_count = data.num_rows if row_count is None else row_count

    @classmethod
    def from_rows(cls, rows: Iterable[object], schema: Schema, batch_size: int = 1024) -> Table:
        if batch_size <= 0:
            raise TableReadError("InvalidBatchSize", f"a batch can't have {batch_size} rows", size=batch_size)
        rows = list(rows) if not schema.fields else rows
        data = arrow_table(rows, schema)
        return cls(data, schema, len(rows) if not schema.fields else None)  # type: ignore[arg-type]

    def __len__(self) -> int:
        return self.row_count

    def _check(self, i: int) -> None:
        if not 0 <= i < self.row_count:
            raise TableReadError("RowOutOfBounds", f"there is no row {i} among {self.row_count}", index=i, row_count=self.row_count)

    def cell(self, i: int, column: int | str) -> object:
        self._check(i)
        j = self.schema.index(column) if isinstance(column, str) else column
        if j is None or not 0 <= j < len(self.schema):
            raise TableReadError("ColumnNotFound", f"there is no column {column!r}", name=column)
        return self.data.column(j)[i].as_py()

    def row(self, i: int) -> tuple:
        self._check(i)
        return tuple(c[i].as_py() for c in self.data.columns)

    def row_as(self, i: int, cls: type) -> object:
        """Row i as an instance of a dataclass with exactly the schema's names."""
        names = [f.name for f in dataclasses.fields(cls)]
        if tuple(names) != self.schema.names:
            raise TableReadError("SchemaMismatch", f"{cls.__name__} has other fields than the table", expected=names, actual=self.schema)
        return cls(*self.row(i))

    def column(self, name: str) -> list:
        j = self.schema.index(name)
        if j is None:
            raise TableReadError("ColumnNotFound", f"there is no column '{name}'", name=name)
        return self.data.column(j).to_pylist()

    def rows(self) -> Iterator[tuple]:
        if not self.schema.fields:
            yield from (() for _ in range(self.row_count))
            return
        yield from zip(*(c.to_pylist() for c in self.data.columns), strict=True)

    def show(self, max_rows: int = 20, max_width: int = 120, max_cell_width: int = 32) -> str:
        for ok, what in ((max_rows >= 0, "max_rows can't be negative"), (max_width >= 8, "max_width can't be below 8"), (max_cell_width >= 1, "max_cell_width can't be below 1")):
            if not ok:
                raise TableReadError("InvalidRenderOptions", what)
        n = min(self.row_count, max_rows)
        head = Table(self.data.slice(0, n), self.schema, n)
        cells = [[_shown(v, f.dtype) for v, f in zip(r, self.schema, strict=True)] for r in head.rows()]
        names = list(self.schema.names)
        widths = [min(max([_units(c), *(_units(r[j]) for r in cells)]), max_cell_width) for j, c in enumerate(names)]
        if widths and widths[0] + 2 > max_width:
            widths[0] = max_width - 2
        fit, used = 0, 1
        while fit < len(widths) and used + widths[fit] + 1 <= max_width:
            used += widths[fit] + 1
            fit += 1
        line = lambda values: "|" + "|".join(_padded(v, w) for v, w in zip(values[:fit], widths[:fit], strict=True)) + "|"
        lines = [line(names), "|" + "|".join("-" * w for w in widths[:fit]) + "|", *map(line, cells)]
        if fit < len(names):
            lines.append(_cut(f"{ELLIPSIS} +{len(names) - fit} cols", max_width))
        if n < self.row_count:
            lines.append(_cut(f"{ELLIPSIS} +{self.row_count - n} rows", max_width))
        return "\n".join(lines)

    def show_schema(self, max_width: int = 120) -> str:
        if max_width < 8:
            raise TableReadError("InvalidRenderOptions", "max_width can't be below 8")
        return "\n".join(["Schema", *(_cut(f"{i}. {f.name}: {f.dtype} {'optional' if f.nullable else 'required'}", max_width) for i, f in enumerate(self.schema))])


def _units(s: str) -> int:
    """Length in UTF-16 units."""
    return len(s.encode("utf-16-le", "surrogatepass")) // 2


def _cut(s: str, width: int) -> str:
    if _units(s) <= width:
        return s
    out, used = [], 0
    for c in s:
        if used + _units(c) > width - 1:
            break
        out.append(c)
        used += _units(c)
    return "".join(out) + ELLIPSIS


def _padded(s: str, width: int) -> str:
    s = _cut(s, width)
    return s + " " * (width - _units(s))


def _shown(v: object, dtype) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return v or '""'
    if dtype.name == "Timestamp":
        n = v if isinstance(v, int) else pa.scalar(v, pa.timestamp("us")).value
        return f"{n}@{(dtype.unit or TimeUnit.MICROSECOND).value}"
    if isinstance(v, float):
        return java_double(v, dtype.name == "Float32")
    return str(v)


def java_double(v: float, single: bool = False) -> str:
    """The shortest decimal that reads back as v, with an exponent outside 1e-3 to 1e7."""
    import numpy as np

    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "Infinity" if v > 0 else "-Infinity"
    x = np.float32(v) if single else np.float64(v)
    if v == 0 or 1e-3 <= abs(v) < 1e7:
        return np.format_float_positional(x, unique=True, trim="0")
    mantissa, _, exponent = np.format_float_scientific(x, unique=True, trim="0", exp_digits=1).partition("e")
    return f"{mantissa}E{int(exponent)}"
