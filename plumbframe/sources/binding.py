"""Bindings: how the rows of a source become a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbframe.errors import SourceError, StorageError
from plumbframe.operators.frame import Frame
from plumbframe.plans.nodes import SourceKind, SourceRef
from plumbframe.plans.requests import ScanRequest
from plumbframe.table import Table
from plumbframe.types import Schema


@dataclass(frozen=True)
class Capabilities:
    """What a source takes over from the query."""

    projection: bool = False
    predicate: bool = False
    limit: bool = True
    batch_size: bool = True


@dataclass(frozen=True)
class ScanPlan:
    """What a source makes of a request: rows with the columns asked for, at least; accepted says in its own words what it took over.
    Whatever it takes over is applied again above it, so taking less, or nothing, is never wrong."""

    dataframe: DataFrame
    columns: tuple[str, ...]
    accepted: tuple[str, ...] = ()


class FrameSource(Protocol):
    """A source of one's own."""

    def inspect(self, spark: SparkSession) -> Schema: ...

    def plan(self, spark: SparkSession, request: ScanRequest) -> ScanPlan: ...


@dataclass(frozen=True)
class SinkReceipt:
    rows: int
    batches: int
    bytes: int


class FrameSink(Protocol):
    """A place of one's own for the batches of a result."""

    def write(self, schema: Schema, batches: Iterable[Table]) -> SinkReceipt: ...


def filled(df: DataFrame, schema: Schema) -> DataFrame:
    """df with the columns of the schema; those that weren't read are null."""
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    return df.select(*[quoted(f.name) if f.name in df.columns else F.lit(None).cast(f.dtype.to_spark()).alias(f.name) for f in schema])


@dataclass(frozen=True)
class SourceBinding:
    """A described source: its schema is exact, and load makes the DataFrame anew for each run.

    one_source marks a binding whose reference was made for it; such bindings can't be combined.
    """

    ref: SourceRef
    schema: Schema
    load: Callable[[SparkSession], DataFrame]
    capabilities: Capabilities = field(default_factory=Capabilities)
    route: str = "memory"
    one_source: bool = False
    plan: Callable[[SparkSession, ScanRequest], ScanPlan] | None = None

    @property
    def columnar(self) -> bool:
        """Whether rows come in columns, not from a parser of rows."""
        return self.route not in ("parser", "spark.read.csv")

    @property
    def frame(self) -> Frame:
        return Frame.values(self.ref, self.schema) if self.ref.kind is SourceKind.VALUES else Frame.scan(self.ref, self.schema)

    def collect(self, spark: SparkSession, query: Callable[[Frame], Frame] = lambda f: f) -> Table:
        from plumbframe.runtime import FrameRuntime

        return FrameRuntime(spark, self).collect(query(self.frame))

    def stream(self, spark: SparkSession, query: Callable[[Frame], Frame] = lambda f: f, batch_size: int = 1024):
        from plumbframe.runtime import FrameRuntime

        return FrameRuntime(spark, self).stream(query(self.frame), batch_size)

    def render(self, spark: SparkSession, query: Callable[[Frame], Frame] = lambda f: f, **options) -> str:
        return self.collect(spark, query).show(**options)


def _spark_frame(spark: SparkSession, table: Table) -> DataFrame:
    if not table.schema.fields:
        return spark.range(table.row_count).select()
    # An explicit schema: a timestamp without a zone would else become one with a zone.
    return spark.createDataFrame(table.data, table.schema.to_spark())


def rows_binding(rows: Iterable[object], schema: Schema, ref: SourceRef | None = None) -> SourceBinding:
    """Rows in memory; their order is kept until the first shuffle."""
    table = Table.from_rows(rows, schema)
    return table_binding(table, ref)


def table_binding(table: Table, ref: SourceRef | None = None) -> SourceBinding:
    return SourceBinding(ref or SourceRef.values("rows"), table.schema, lambda spark: _spark_frame(spark, table), Capabilities(projection=True, batch_size=False), "memory", ref is None)


def dataframe_binding(df: DataFrame, schema: Schema | None = None, ref: SourceRef | None = None) -> SourceBinding:
    """A DataFrame as it is; with a schema its names and types must be the same, and nullability is taken from the schema."""
    have = Schema.from_spark(df.schema)
    want = schema or have
    check_types(want, have)
    return SourceBinding(ref or SourceRef.scan("dataframe"), want, lambda _: df, Capabilities(True, True, True, False), "dataframe", ref is None)


def source_binding(spark: SparkSession, source: FrameSource, ref: SourceRef | None = None) -> SourceBinding:
    """A source of one's own, which is asked for its schema once, and for a plan each time a frame runs."""
    schema = source.inspect(spark)
    return SourceBinding(ref or SourceRef.scan("source"), schema, lambda session: source.plan(session, ScanRequest(columns=schema.names)).dataframe, Capabilities(True, True, True, True), type(source).__name__, ref is None, source.plan)


def parquet_binding(path: str, schema: Schema, ref: SourceRef | None = None, *, verify_required: bool = False) -> SourceBinding:
    """Parquet files. Spark prunes columns and pushes predicates; verify_required looks for nulls in required columns first (one pass)."""

    inspected: list[T.StructType] = []

    def load(spark: SparkSession) -> DataFrame:
        if inspected:  # footers are read once for a binding
            return spark.read.schema(inspected[0]).parquet(path)
        df = spark.read.parquet(path)
        if missing := [n for n in schema.names if n not in df.columns]:
            raise SourceError("MissingColumn", f"there is no column '{missing[0]}'", name=missing[0])
        df = df.select(*[F.col("`" + n.replace("`", "``") + "`") for n in schema.names])
        check_types(schema, Schema.from_spark(df.schema))
        required = [f.name for f in schema if not f.nullable]
        if verify_required and required:
            found = df.agg(*[F.max(F.col("`" + n.replace("`", "``") + "`").isNull()) for n in required]).first()
            for n, bad in zip(required, found, strict=True):
                if bad:
                    raise StorageError("RequiredColumnContainsNull", f"required column '{n}' contains null", name=n)
        inspected.append(df.schema)
        return df

    return SourceBinding(ref or SourceRef.scan("parquet"), schema, load, Capabilities(True, True, True, False), "parquet", ref is None)


def check_types(want: Schema, have: Schema) -> None:
    issues = [i for i in want.issues(have) if i.kind != "FieldNullability"]
    # A timestamp of another unit is stored as a whole number.
    issues = [i for i in issues if not (i.kind == "FieldType" and str(i.expected).startswith("Timestamp") and str(i.actual) == "Int64" and want.fields[i.index].dtype.to_spark() == have.fields[i.index].dtype.to_spark())]
    if issues:
        raise SourceError("SchemaMismatch", "; ".join(i.message for i in issues), issues=issues)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


