"""Incremental reading of finite results, and row-wise frames over Structured Streaming.

Projection, filter and union (and a limit, in batches) work row by row; joins, groups and sorts need all their input, so over an
unbounded source they are refused rather than given another meaning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from plumbframe.errors import ExecutionError, translated
from plumbframe.operators.frame import Frame
from plumbframe.plans import nodes as N
from plumbframe.plans.lower import Lowering
from plumbframe.table import Table

if TYPE_CHECKING:
    from plumbframe.runtime import FrameRuntime


def batches(runtime: FrameRuntime, frame: Frame, size: int) -> Iterator[Table]:
    """Tables of at most size rows; one partition is fetched at a time."""
    plan = frame.plan
    if isinstance(plan, N.UnionAll):
        yield from batches(runtime, Frame(plan.left), size)
        yield from batches(runtime, Frame(plan.right), size)
        return
    try:
        rows: list[tuple] = []
        for r in runtime._lowering.lower(plan, runtime._asking(frame)).toLocalIterator():
            rows.append(tuple(r))
            if len(rows) == size:
                yield Table.from_rows(rows, frame.schema, size)
                rows = []
        if rows:
            yield Table.from_rows(rows, frame.schema, size)
    except Exception as e:
        if (better := translated(e)) is not e:
            raise better from e
        raise


def over_stream(frame: Frame, streams: dict[str, DataFrame]) -> DataFrame:
    """The streaming DataFrame of a row-wise frame; streams has that of each source, by id. Write it in append mode."""
    for p in N.walk(frame.plan):
        if isinstance(p, N.Join | N.Aggregate | N.Sort | N.Limit):
            raise ExecutionError("UnsupportedNode", f"{type(p).__name__} needs all of its input, which a stream never gives")

    def bound(s: N.Source) -> DataFrame:
        if s.ref.id not in streams:
            raise ExecutionError("MissingSource", f"source '{s.ref.id}' has no stream")
        return streams[s.ref.id]

    find: Callable[[N.Source], DataFrame] = bound
    return Lowering().named(frame.plan, find)
