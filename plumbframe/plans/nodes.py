"""The eight plan nodes. Plans are values: no data, no session; Catalyst does all optimizing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

from plumbframe.errors import FrameError
from plumbframe.functions.expr import Aggregate as Agg
from plumbframe.functions.expr import BinaryNode, ColumnRef, Expr, Literal, ScopeToken, SortKey, UnaryNode
from plumbframe.types import Schema


class SourceKind(Enum):
    SCAN = "Scan"
    VALUES = "Values"


class Ordering(Enum):
    """What is known of the order of rows."""

    UNSPECIFIED = "Unspecified"
    STABLE = "Stable"
    SORTED = "Sorted"


@dataclass(frozen=True)
class SourceRef:
    """Identity, kind and declared order of a source."""

    id: str
    name: str
    kind: SourceKind = SourceKind.SCAN
    order: Ordering = Ordering.UNSPECIFIED

    def __post_init__(self) -> None:
        if self.id is None:
            raise FrameError("NullSourceId", "a source needs an id")
        if not self.id.strip():
            raise FrameError("InvalidSourceId", "a source's id is blank", id=self.id)
        if self.name is None:
            raise FrameError("NullSourceName", "a source needs a name")
        if not self.name.strip():
            raise FrameError("InvalidSourceName", "a source's name is blank", name=self.name)
        if self.order is None:
            raise FrameError("NullSourceOrder", "a source needs an order")
        if not isinstance(self.order, Ordering):
            raise FrameError("InvalidSourceOrder", "a source's order is none that is known")

    @classmethod
    def scan(cls, id: str, name: str | None = None, order: Ordering = Ordering.UNSPECIFIED) -> SourceRef:
        return cls(id, id if name is None else name, SourceKind.SCAN, order)

    @classmethod
    def values(cls, id: str, name: str | None = None) -> SourceRef:
        return cls(id, id if name is None else name, SourceKind.VALUES, Ordering.STABLE)


class JoinKind(Enum):
    INNER = "Inner"
    LEFT_OUTER = "LeftOuter"
    RIGHT_OUTER = "RightOuter"
    LEFT_SEMI = "LeftSemi"
    LEFT_ANTI = "LeftAnti"


@dataclass(frozen=True, eq=False)
class Plan:
    schema: Schema

    @property
    def children(self) -> tuple[Plan, ...]:
        return tuple(v for v in vars(self).values() if isinstance(v, Plan))

    @property
    def order(self) -> Ordering:
        return self.children[0].order


@dataclass(frozen=True, eq=False)
class Source(Plan):
    ref: SourceRef

    @property
    def order(self) -> Ordering:
        return self.ref.order


@dataclass(frozen=True, eq=False)
class Project(Plan):
    input: Plan
    scope: ScopeToken
    exprs: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True, eq=False)
class Filter(Plan):
    input: Plan
    scope: ScopeToken
    predicate: Expr


@dataclass(frozen=True, eq=False)
class Join(Plan):
    """keep: which columns of left ++ right come out, by position."""

    left: Plan
    right: Plan
    left_scope: ScopeToken
    right_scope: ScopeToken
    kind: JoinKind
    condition: Expr
    keep: tuple[int, ...]

    @property
    def order(self) -> Ordering:
        return Ordering.UNSPECIFIED


@dataclass(frozen=True, eq=False)
class UnionAll(Plan):
    left: Plan
    right: Plan

    @property
    def order(self) -> Ordering:
        return Ordering.UNSPECIFIED if Ordering.UNSPECIFIED in (self.left.order, self.right.order) else Ordering.STABLE


@dataclass(frozen=True, eq=False)
class Aggregate(Plan):
    input: Plan
    scope: ScopeToken
    keys: tuple[tuple[str, Expr], ...]
    aggregates: tuple[tuple[str, Agg], ...]
    distinct: bool = False

    @property
    def order(self) -> Ordering:
        return Ordering.UNSPECIFIED


@dataclass(frozen=True, eq=False)
class Sort(Plan):
    input: Plan
    scope: ScopeToken
    keys: tuple[SortKey, ...]

    @property
    def order(self) -> Ordering:
        return Ordering.SORTED


@dataclass(frozen=True, eq=False)
class Limit(Plan):
    input: Plan
    count: int


def walk(plan: Plan) -> Iterator[Plan]:
    yield plan
    for c in plan.children:
        yield from walk(c)


def sources(plan: Plan) -> list[Source]:
    return [p for p in walk(plan) if isinstance(p, Source)]


def blocking(plan: Plan) -> bool:
    """Whether a node needs all its input before its first row."""
    return any(isinstance(p, Join | Aggregate | Sort) for p in walk(plan))


def explain(plan: Plan) -> str:
    """The plan as text: nodes by indentation, expressions by labels, no values of literals."""
    labels: dict[tuple, str] = {}
    told: list[str] = []

    def label(e: Expr) -> str:
        key = e.key()
        if key not in labels:
            labels[key] = f"e{len(labels) + 1}"
            at = len(told)
            told.append("")
            n = e.node
            match n:
                case ColumnRef():
                    text = f"column({n.index})"
                case Literal():
                    text = f"literal({'null ' if n.value is None else ''}{e.dtype})"
                case UnaryNode():
                    text = f"{n.op.value}({label(n.child)})"
                case BinaryNode():
                    text = f"{n.op.value}({label(n.left)}, {label(n.right)})"
            told[at] = f"  {labels[key]} = {text}"
        return labels[key]

    def lines(p: Plan, depth: int) -> list[str]:
        match p:
            case Source():
                what = f"{p.ref.kind.value}[{p.ref.name}; id={p.ref.id}]"
            case Project():
                what = f"Project[{', '.join(f'{n}={label(e)}' for n, e in p.exprs)}]"
            case Filter():
                what = f"Filter[{label(p.predicate)}]"
            case Join():
                what = f"Join[{p.kind.value}; {label(p.condition)}]"
            case UnionAll():
                what = f"UnionAll[order={p.order.value}]"
            case Aggregate():
                what = f"Aggregate[{', '.join(n for n, _ in (*p.keys, *p.aggregates))}]"
            case Sort():
                what = f"Sort[{', '.join(f'{label(k.expr)}:{k.order.value}:{k.nulls.value}' for k in p.keys)}]"
            case Limit():
                what = f"Limit[{p.count}]"
        out = ["  " * depth + f"{what} {p.schema!r}"]
        for c in p.children:
            out += lines(c, depth + 1)
        return out

    nodes = lines(plan, 0)
    return "\n".join([*nodes, "Expressions", *told] if told else nodes)
