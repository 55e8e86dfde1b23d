"""CSV and TSV, lossless: a quoted cell is always data, only an unquoted one can be null.

Where the options allow it, files are read by Spark's own reader; else by the state machine here, which is fed with lines. Where no line of the files holds an
odd number of quotes, no cell goes beyond a line, and each split of a file is a task; else the lines of a file go in order through one task, a batch at a time. No file is ever
held as a whole. All raise on malformed input. The route that ran stands in the binding.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbframe.errors import OptionError, PlumbError, SinkError, SourceError, StorageError
from plumbframe.plans.nodes import SourceRef
from plumbframe.sources.binding import Capabilities, SinkReceipt, SourceBinding, _spark_frame
from plumbframe.table import Table, arrow_table
from plumbframe.types import DataType, Schema, TimeUnit

BOM = "﻿"


class Coercion(Enum):
    STRICT = "Strict"
    TRIM_WHITESPACE = "TrimWhitespace"


@dataclass(frozen=True)
class NullPolicy:
    """Unquoted cells that are null, and the one of them that is written."""

    tokens: frozenset[str] = frozenset({"", "null"})
    write_token: str = ""

    def __post_init__(self) -> None:
        if self.tokens is None or any(t is None for t in self.tokens):
            raise OptionError("NullToken", "a null token is missing")
        object.__setattr__(self, "tokens", frozenset(self.tokens))
        if not self.tokens:
            raise OptionError("EmptyTokens", "there is no null token")
        if self.write_token is None:
            raise OptionError("NullWriteToken", "there is no token to write")
        if self.write_token not in self.tokens:
            raise OptionError("WriteTokenNotRecognized", "the token to write isn't read as null")


@dataclass(frozen=True)
class Limits:
    """Bounds in UTF-16 units, which are what is counted for a record and a field."""

    max_record: int = 16 * 1024 * 1024
    max_field: int = 4 * 1024 * 1024
    max_excerpt: int = 160

    def __post_init__(self) -> None:
        for code, v in (("NonPositiveRecord", self.max_record), ("NonPositiveField", self.max_field), ("NonPositiveErrorExcerpt", self.max_excerpt)):
            if v <= 0:
                raise OptionError(code, f"a limit can't be {v}", value=v)
        if self.max_field > self.max_record:
            raise OptionError("FieldExceedsRecord", "a field can't be larger than a record")


@dataclass(frozen=True)
class DelimitedOptions:
    schema: Schema
    delimiter: str = ","
    header: bool = True
    nulls: NullPolicy = field(default_factory=NullPolicy)
    coercion: Coercion = Coercion.STRICT
    batch_size: int = 1024
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self) -> None:
        if len(self.delimiter) != 1 or self.delimiter in '"\r\n':
            raise SourceError("InvalidRequest", "a delimiter is one character, no quote or line end")
        if self.batch_size <= 0:
            raise SourceError("InvalidRequest", f"a batch can't have {self.batch_size} rows")
        if not self.schema.fields:
            raise SourceError("InvalidRequest", "delimited text needs a column")
        for t in self.nulls.tokens:
            if any(c in t for c in (self.delimiter, '"', "\r", "\n")):
                raise SourceError("InvalidRequest", "a null token holds a delimiter, quote or line end")

    @property
    def native(self) -> bool:
        """Whether Spark's reader has the same rules: it can't tell a quoted null token from one that isn't quoted, but for the empty one."""
        return self.nulls.tokens == frozenset({""}) and self.coercion is Coercion.STRICT and self.header and len(self.schema) > 1 and all(f.dtype.name == "Utf8" for f in self.schema)


def csv_options(schema: Schema, **options) -> DelimitedOptions:
    return DelimitedOptions(schema, **options)


def tsv_options(schema: Schema, **options) -> DelimitedOptions:
    return DelimitedOptions(schema, delimiter="\t", **options)


def _units(s: str) -> int:
    return len(s) if s.isascii() else len(s) + sum(c > "￿" for c in s)


def _malformed(record: int, at: int, what: str) -> SourceError:
    return SourceError("MalformedDelimited", f"record {record} field {at}: {what}", record=record, field=at)


Cell = tuple[str, bool]


def records(text: str, delimiter: str, limits: Limits, number: int = 0) -> Iterator[list[Cell]]:
    """(value, quoted) of each cell of each record. A blank line is a record of one empty cell; a line end at the end starts none. number: the records before."""
    if not number and text.startswith(BOM):
        text = text[1:]
    at, n = 0, len(text)
    line_end = re.compile(r"\r\n|\r|\n")
    plain_end = re.compile(f"[{re.escape(delimiter)}\r\n\"]")
    while at < n:
        number += 1
        m = line_end.search(text, at)
        stop = m.start() if m else n
        line = text[at:stop]
        if '"' not in line:
            cells = [(c, False) for c in line.split(delimiter)]
            after = m.end() if m else n
            start = at
        else:
            cells, start, p = [], at, at
            while True:
                if p < n and text[p] == '"':
                    parts, p = [], p + 1
                    while True:
                        q = text.find('"', p)
                        if q < 0:
                            raise _malformed(number, len(cells) + 1, "a quote isn't closed")
                        parts.append(text[p:q])
                        if text[q + 1 : q + 2] == '"':
                            parts.append('"')
                            p = q + 2
                            continue
                        p = q + 1
                        break
                    cells.append(("".join(parts), True))
                    if p < n and text[p] not in (delimiter, "\r", "\n"):
                        raise _malformed(number, len(cells), "text follows a closing quote")
                else:
                    e = plain_end.search(text, p)
                    q = e.start() if e else n
                    if e and e[0] == '"':
                        raise _malformed(number, len(cells) + 1, "a quote stands inside an unquoted cell")
                    cells.append((text[p:q], False))
                    p = q
                if p < n and text[p] == delimiter:
                    p += 1
                    continue
                stop = p
                m = line_end.match(text, p)
                after = m.end() if m else n
                break
        if stop - start > limits.max_record // 2 and _units(text[start:stop]) > limits.max_record:
            raise _malformed(number, 0, "the record is too long")
        for i, (c, _) in enumerate(cells):
            if len(c) > limits.max_field // 2 and _units(c) > limits.max_field:
                raise _malformed(number, i + 1, "the field is too long")
        yield cells
        at = after


_INT = re.compile(r"[+-]?[0-9]+\Z")
_FLOAT = re.compile(r"[+-]?(?:NaN|Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?)\Z")


def decode(value: str, dtype: DataType) -> object:
    """The value of a cell; ValueError if it has none."""
    match dtype.name:
        case "Utf8":
            return value
        case "Bool":
            if value not in ("true", "false"):
                raise ValueError
            return value == "true"
        case "Int32" | "Int64" | "Timestamp":
            if not _INT.match(value):
                raise ValueError
            v, bits = int(value), 31 if dtype.name == "Int32" else 63
            if not -(2**bits) <= v < 2**bits:
                raise ValueError
            return v
        case _:
            if not _FLOAT.match(value):
                raise ValueError
            return float(value.rstrip("fFdD") if value[-1] in "fFdD" and not value.endswith("Infinity") else value.replace("Infinity", "inf"))


def rows_of(text: str, o: DelimitedOptions, number: int = 0) -> Iterator[list[object]]:
    """Decoded rows; the header is checked where there is one. number: the records of the file before this text."""
    names = list(o.schema.names)
    found = records(text, o.delimiter, o.limits, number)
    if o.header and not number:
        number = 1
        first = next(found, None)
        if first is None:
            raise SourceError("SchemaMismatch", "there is no header")
        if [c for c, _ in first] != names:
            raise SourceError("SchemaMismatch", "the header has other names than the schema")
    for cells in found:
        number += 1
        if len(cells) != len(names):
            raise _malformed(number, len(cells), f"{len(cells)} fields where {len(names)} are expected")
        row: list[object] = []
        for i, ((value, quoted), f) in enumerate(zip(cells, o.schema, strict=True)):
            if not quoted and o.coercion is Coercion.TRIM_WHITESPACE:
                value = value.strip()
            if not quoted and value in o.nulls.tokens:
                if not f.nullable:
                    raise StorageError("RequiredColumnContainsNull", f"required column '{f.name}' contains null", name=f.name)
                row.append(None)
                continue
            try:
                row.append(decode(value, f.dtype))
            except ValueError:
                raise SourceError("Decode", f"record {number} field {i + 1} is no {f.dtype}", record=number, field=i + 1, expected=f.dtype) from None
        yield row


def as_text(data: str | bytes) -> str:
    if isinstance(data, str):
        return data
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise SourceError("InvalidUtf8", f"byte {e.start} isn't UTF-8", byte_offset=e.start) from e


def delimited_binding(data: str | bytes, options: DelimitedOptions, ref: SourceRef | None = None) -> SourceBinding:
    """Text in memory, parsed when it is read."""

    def load(spark: SparkSession) -> DataFrame:
        return _spark_frame(spark, Table(arrow_table(rows_of(as_text(data), options), options.schema), options.schema))

    return SourceBinding(ref or SourceRef.scan("delimited"), options.schema, load, Capabilities(), "parser", ref is None)


def delimited_path_binding(path: str, options: DelimitedOptions, ref: SourceRef | None = None) -> SourceBinding:
    """Files below path, opened when they are read; files of no bytes have no rows."""
    native = options.native
    return SourceBinding(ref or SourceRef.scan("delimited"), options.schema, (_native if native else _parsed)(path, options), Capabilities(projection=native), "spark.read.csv" if native else "parser", ref is None)


#: Stands for a quoted empty cell while Spark's reader has it, which else takes it for null.
_EMPTY = "\ue000plumbframe-empty\ue000"


def _native(path: str, o: DelimitedOptions) -> Callable[[SparkSession], DataFrame]:
    def load(spark: SparkSession) -> DataFrame:
        df = spark.read.csv(path, schema=o.schema.to_spark(), sep=o.delimiter, header=True, enforceSchema=False, mode="FAILFAST", multiLine=True, quote='"', escape='"', nullValue="", emptyValue=_EMPTY)
        cells = [(f.name, F.col("`" + f.name.replace("`", "``") + "`")) for f in o.schema]
        return df.select(*[F.when(c == _EMPTY, F.lit("")).otherwise(c).alias(n) for n, c in cells])

    return load


#: Bytes of lines that are parsed together.
CHUNK = 1 << 18


def _parsed(path: str, o: DelimitedOptions) -> Callable[[SparkSession], DataFrame]:
    schema = o.schema.to_arrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, passed, size, odd = None, 0, 0, 0, False
        waiting: list[bytes] = []

        def parsed() -> Iterator[pa.RecordBatch]:
            """The rows of what waits, in batches."""
            nonlocal number, passed, size, odd
            text, before = b"\n".join(waiting) + b"\n", passed
            waiting.clear()
            passed, size, odd = passed + len(text), 0, False
            # A split that doesn't begin its file has records before it; how many isn't known.
            part: list[list[object]] = []
            try:
                try:
                    decoded = text.decode("utf-8")
                except UnicodeDecodeError as e:
                    raise SourceError("InvalidUtf8", f"byte {before + e.start} isn't UTF-8", byte_offset=before + e.start) from e
                header = int(o.header and not number)
                for row in rows_of(decoded, o, number):
                    part.append(row)
                    number += 1
                    if len(part) >= o.batch_size:
                        yield made(part)
                        part = []
                number += header
            except PlumbError as e:
                raise ValueError(f"plumbframe:delimited:{e.code}:{e.message}") from None
            if part:
                yield made(part)

        def made(part: list[list[object]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for line, file, start in zip(*(b.column(c) for c in range(3)), strict=True):
                if here != (file.as_py(), start.as_py()):
                    if waiting:
                        yield from parsed()
                    here = (file.as_py(), start.as_py())
                    number, passed = (0 if here[1] == 0 else 1), here[1]
                raw = line.as_py()
                waiting.append(raw)
                size += len(raw) + 1
                odd ^= bool(raw.count(b'"') % 2)
                if size >= CHUNK and not odd:
                    yield from parsed()
        if waiting:
            yield from parsed()

    def load(spark: SparkSession) -> DataFrame:
        value = F.col("value")
        lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        across = lines.filter((F.length(value) - F.length(F.replace(value, F.lit('"')))) % 2 == 1).limit(1).count()
        raw = value.cast("binary").alias("value")
        if not across:
            return lines.select(raw, "file", "start").mapInArrow(run, o.schema.to_spark())
        ordered = lines.withColumn("at", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "start", "at")
        return ordered.select(raw, "file", F.lit(0).cast("long").alias("start")).mapInArrow(run, o.schema.to_spark())

    return load


# Headers


@dataclass(frozen=True)
class HeaderOptions:
    delimiter: str = ","
    max_columns: int = 1024
    limits: Limits = field(default_factory=Limits)


def header_names(data: str | bytes, options: HeaderOptions | None = None) -> list[str]:
    """The names in the first record; nothing after it is looked at."""
    o = options or HeaderOptions()
    text = data if isinstance(data, str) else data.decode("utf-8", "surrogateescape")
    first = next(records(text, o.delimiter, o.limits), None)
    if not isinstance(data, str) and any("\udc80" <= c <= "\udcff" for cell, _ in first or [] for c in cell):
        raise SourceError("InvalidUtf8", "the header isn't UTF-8")
    if first is None:
        raise SourceError("SchemaMismatch", "there is no header")
    names = [c for c, _ in first]
    if len(names) > o.max_columns:
        raise SourceError("SchemaMismatch", f"the header has {len(names)} columns, more than {o.max_columns}")
    for i, n in enumerate(names):
        if not n.strip():
            raise SourceError("SchemaMismatch", f"header field {i + 1} is blank")
    if len(set(names)) < len(names):
        raise SourceError("SchemaMismatch", "the header has a name twice")
    return names


def header_names_of_path(spark: SparkSession, path: str, options: HeaderOptions | None = None) -> list[str]:
    """header_names of the first file below path, of which only the beginning is read."""
    o = options or HeaderOptions()
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    n = 1
    while True:
        # As many lines as the header needs, however long it is, found by doubling.
        head = [bytes(r[0]) for r in lines.limit(n).collect()]
        for i in range(1, len(head) + 1):
            if b"\n".join(head[:i]).count(b'"') % 2 == 0:
                return header_names(b"\n".join(head[:i]) + b"\n", o)
        if len(head) < n or sum(map(len, head)) > 4 * o.limits.max_record:
            return header_names(b"\n".join(head), o)
        n *= 2


# Sinks


def _cell(c: Column, dtype: DataType, o: DelimitedOptions) -> Column:
    if dtype.name == "Timestamp" and dtype.unit is TimeUnit.MICROSECOND:
        c = F.unix_micros(c.cast("timestamp"))
    text = c.cast("string")
    if dtype.name == "Utf8":
        special = re.escape(o.delimiter) + '"\r\n'
        forced = F.rlike(text, F.lit(f"[{special}]")) | (text == "") | (F.trim(text) != text) | F.rlike(text, F.lit(r"\A\s|\s\z")) | text.isin(*o.nulls.tokens) | F.startswith(text, F.lit(BOM))
        text = F.when(forced, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.coalesce(text, F.lit(o.nulls.write_token))


def _header(o: DelimitedOptions) -> str:
    plain = re.compile(f"[^{re.escape(o.delimiter)}\"\r\n]+\\Z")
    return o.delimiter.join(n if plain.match(n) and n.strip() == n and not n.startswith(BOM) and n not in o.nulls.tokens else '"' + n.replace('"', '""') + '"' for n in o.schema.names)


def lines(df: DataFrame, o: DelimitedOptions) -> DataFrame:
    """One column, value: each row as a line without its end."""
    have = Schema.from_spark(df.schema)
    if [(f.name, f.dtype.to_spark()) for f in o.schema] != [(f.name, f.dtype.to_spark()) for f in have]:
        raise SinkError("SchemaMismatch", "the rows have another schema than the sink")
    return df.select(F.concat_ws(o.delimiter, *[_cell(F.col("`" + f.name.replace("`", "``") + "`"), f.dtype, o) for f in o.schema]).alias("value"))


def to_text(df: DataFrame, options: DelimitedOptions) -> tuple[str, SinkReceipt]:
    """All rows as one text on the driver, in order."""
    out = [r[0] for r in lines(df, options).toLocalIterator()]
    text = "".join(f"{x}\n" for x in ([_header(options)] if options.header else []) + out)
    return text, SinkReceipt(len(out), -(-len(out) // options.batch_size), len(text.encode("utf-8")))


def write_text(df: DataFrame, path: str, options: DelimitedOptions) -> None:
    """Files below path, written by the executors; each has the header where there is one."""
    body = lines(df, options)
    if options.header:
        head = _header(options)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

        body = body.mapInArrow(run, "value string")
    body.write.text(path)
