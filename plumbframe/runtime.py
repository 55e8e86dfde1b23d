"""FrameRuntime: binds sources to a session and runs frames on it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from enum import Enum

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbframe.errors import ExecutionError, RuntimeBindingError, SourceError, StorageError, translated
from plumbframe.operators.frame import Frame
from plumbframe.plans import nodes as N
from plumbframe.plans.lower import Lowering
from plumbframe.plans.requests import ScanRequest, scan_requests
from plumbframe.sources.binding import FrameSink, ScanPlan, SinkReceipt, SourceBinding, filled
from plumbframe.table import Table

#: What the semantics of the algebra need of a session.
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC"}


class EnginePolicy(Enum):
    """There is one engine, which each receipt names with the policy. REQUIRE_COLUMNAR refuses sources that are parsed row by row."""

    AUTO = "Auto"
    REFERENCE_ONLY = "ReferenceOnly"
    REQUIRE_COLUMNAR = "RequireColumnar"


@dataclass(frozen=True)
class PushdownReceipt:
    """What a source was asked for and what its scan took over, as the executed plan tells."""

    source: str
    requested: ScanRequest
    accepted: tuple[str, ...]
    columns_read: tuple[str, ...]


@dataclass(frozen=True)
class ExecutionReceipt:
    sources: tuple[PushdownReceipt, ...]
    engine: str = "spark"
    policy: EnginePolicy = EnginePolicy.AUTO
    rules: tuple[str, ...] = ("catalyst",)
    physical: str = field(default="", repr=False)


class FrameRuntime:
    """Use it as a context manager or keep it; it owns nothing that must be closed."""

    def __init__(self, spark: SparkSession, *bindings: SourceBinding, policy: EnginePolicy = EnginePolicy.AUTO, strict_zero: bool = True):
        if twice := [i for i, k in Counter(b.ref.id for b in bindings).items() if k > 1]:
            raise RuntimeBindingError("DuplicateSource", f"source '{twice[0]}' is bound twice", id=twice[0])
        if len(bindings) > 1 and (own := [b.ref.id for b in bindings if b.one_source]):
            raise RuntimeBindingError("SingleSourceIdentityInMultiBinding", f"source '{own[0]}' was bound to be used alone; give each source a reference", ids=own)
        for k, v in SETTINGS.items():
            if spark.conf.get(k, None) != v:
                spark.conf.set(k, v)
        self.spark, self.policy = spark, policy
        self._bindings = {b.ref.id: b for b in bindings}
        self._lowering = Lowering(strict_zero)

    def __enter__(self) -> FrameRuntime:
        return self

    def __exit__(self, *_: object) -> None:
        return None

    # Binding

    def _check(self, plan: N.Plan) -> None:
        first: dict[str, N.Source] = {}
        for s in N.sources(plan):
            if first.setdefault(s.ref.id, s).schema != s.schema:
                raise RuntimeBindingError("ConflictingPlanSchema", f"source '{s.ref.id}' is used with two schemas", id=s.ref.id)
        for s in first.values():
            b = self._bindings.get(s.ref.id)
            if b is None:
                raise RuntimeBindingError("MissingSource", f"source '{s.ref.id}' isn't bound", id=s.ref.id)
            if self.policy is EnginePolicy.REQUIRE_COLUMNAR and not b.columnar:
                raise RuntimeBindingError("NotColumnar", f"source '{s.ref.id}' is read row by row ({b.route}), which the policy refuses", id=s.ref.id)
            if b.schema != s.schema:
                raise RuntimeBindingError("SourceSchema", f"source '{s.ref.id}' has another schema than the query expects", id=s.ref.id, expected=s.schema, actual=b.schema)

    def _bound(self, s: N.Source, request: ScanRequest | None = None, told: dict[str, ScanPlan] | None = None) -> DataFrame:
        b = self._bindings[s.ref.id]
        try:
            if b.plan is None:
                return b.load(self.spark)
            planned = b.plan(self.spark, request or ScanRequest())
            if told is not None:
                told[s.ref.id] = planned
            return filled(planned.dataframe, b.schema)
        except SourceError as e:
            raise RuntimeBindingError("Source", f"source '{s.ref.id}': {e.message}", id=s.ref.id, error=e) from e

    def dataframe(self, frame: Frame) -> DataFrame:
        """The lazy DataFrame of a frame; the way to write results that don't fit the driver."""
        self._check(frame.plan)
        return self._lowering.named(frame.plan, self._asking(frame))

    def _asking(self, frame: Frame, told: dict[str, ScanPlan] | None = None) -> Callable[[N.Source], DataFrame]:
        """Binds each source of a frame with what the frame asks of it; told gets the plans that sources of one's own made."""
        asked = scan_requests(frame.plan)
        return lambda s: self._bound(s, asked[s.ref.id], told)

    # Running

    def write(self, frame: Frame, sink: FrameSink, batch_size: int = 1024) -> SinkReceipt:
        """Stream the rows of a frame through the driver into a sink; large results are written from dataframe()."""
        return sink.write(frame.schema, self.stream(frame, batch_size))

    def collect(self, frame: Frame) -> Table:
        return self.collect_with_receipt(frame)[0]

    def collect_with_receipt(self, frame: Frame) -> tuple[Table, ExecutionReceipt]:
        self._check(frame.plan)
        told: dict[str, ScanPlan] = {}
        try:
            # The names of the plan may be equal or odd, so Spark sees positions.
            df = self._lowering.lower(frame.plan, self._asking(frame, told))
            if not frame.schema.fields:
                n = df.count()
                table = Table(pa.table({"_": pa.nulls(n)}).select([]), frame.schema, n)
            else:
                table = Table(_as_schema(df.toArrow(), frame), frame.schema)
        except Exception as e:
            if (better := translated(e)) is not e:
                raise better from e
            raise
        return table, self._receipt(frame, df, told)

    def _receipt(self, frame: Frame, df: DataFrame, told: dict[str, ScanPlan]) -> ExecutionReceipt:
        physical = df._jdf.queryExecution().executedPlan().toString()
        read = re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")), re.S)
        pushed = re.findall(r"PushedFilters: \[(.*?)\]", physical)
        out = []
        requests = scan_requests(frame.plan)
        scans = [s for s in {s.ref.id: s for s in N.sources(frame.plan)}.values() if s.ref.id not in told]
        out += [PushdownReceipt(i, requests[i], p.accepted, p.columns) for i, p in told.items()]
        for i, s in enumerate(scans):
            columns = tuple(c.partition(":")[0] for c in read[i].split(",")) if i < len(read) and read[i] else s.schema.names
            out.append(PushdownReceipt(s.ref.id, requests[s.ref.id], tuple(x for x in (pushed[i].split(", ") if i < len(pushed) else []) if x), columns))
        return ExecutionReceipt(tuple(out), policy=self.policy, physical=physical)

    # Streaming of finite results

    def stream(self, frame: Frame, batch_size: int = 1024) -> Iterator[Table]:
        return self.stream_with_receipt(frame, batch_size)[0]

    def stream_with_receipt(self, frame: Frame, batch_size: int = 1024) -> tuple[Iterator[Table], ExecutionReceipt]:
        """Tables of at most batch_size rows, taken partition by partition; of a union at the root the right side is
        opened when the left has ended."""
        from plumbframe.streaming import batches

        if batch_size <= 0:
            raise ExecutionError("InvalidBatchSize", f"a batch can't have {batch_size} rows")
        self._check(frame.plan)
        told: dict[str, ScanPlan] = {}
        df = self._lowering.lower(frame.plan, self._asking(frame, told))
        return batches(self, frame, batch_size), self._receipt(frame, df, told)

    # Explanations

    def physical_explain(self, frame: Frame, mode: str = "formatted") -> str:
        df = self.dataframe(frame)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def stream_physical_explain(self, frame: Frame) -> str:
        route = "materialized first" if N.blocking(frame.plan) else "incremental"
        return f"route: {route}\n{self.physical_explain(frame)}"


def _as_schema(found: pa.Table, frame: Frame) -> pa.Table:
    want = frame.schema.to_arrow()
    columns = []
    for f, c in zip(frame.schema, found.columns, strict=True):
        if not f.nullable and c.null_count:
            raise StorageError("RequiredColumnContainsNull", f"required column '{f.name}' contains null", name=f.name)
        columns.append(c.cast(f.dtype.to_arrow()))
    return pa.Table.from_arrays(columns, schema=want)
