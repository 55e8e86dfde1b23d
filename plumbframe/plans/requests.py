"""What a query asks of each of its sources: the columns that anything above reads, and the limit and the portable predicate that stand directly above it.

Spark pushes more than that into a scan; requests are for receipts and for sources of one's own, which get them when they plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from plumbframe.functions.expr import Binary, BinaryNode, ColumnRef, Expr, Literal, Unary, UnaryNode
from plumbframe.plans import nodes as N

COMPARISONS = {Binary.EQ, Binary.NE, Binary.LT, Binary.LE, Binary.GT, Binary.GE}

#: The same comparison with its sides exchanged.
MIRRORED = {Binary.LT: Binary.GT, Binary.LE: Binary.GE, Binary.GT: Binary.LT, Binary.GE: Binary.LE}


@dataclass(frozen=True)
class Compare:
    column: str
    op: Binary
    value: object


@dataclass(frozen=True)
class IsNull:
    column: str


@dataclass(frozen=True)
class Both:
    left: Portable
    right: Portable


@dataclass(frozen=True)
class Either:
    left: Portable
    right: Portable


Portable = Compare | IsNull | Both | Either


@dataclass(frozen=True)
class ScanRequest:
    predicate: Portable | None = None
    limit: int | None = None
    batch_size: int = 1024
    columns: tuple[str, ...] | None = None


def portable(e: Expr) -> Portable | None:
    """The predicate in terms that any source understands: columns against values, null tests, and, or; None if it isn't all of these."""
    n = e.node
    if isinstance(n, UnaryNode):
        if n.op is Unary.IS_TRUE:
            return portable(n.child)
        if n.op is Unary.IS_NULL and isinstance(n.child.node, ColumnRef):
            return IsNull(n.child.node.name)
        return None
    if not isinstance(n, BinaryNode):
        return None
    if n.op in (Binary.AND, Binary.OR):
        left, right = portable(n.left), portable(n.right)
        if left is None or right is None:
            return None
        return Both(left, right) if n.op is Binary.AND else Either(left, right)
    if n.op not in COMPARISONS:
        return None
    a, b = n.left.node, n.right.node
    if isinstance(a, ColumnRef) and isinstance(b, Literal) and b.value is not None:
        return Compare(a.name, n.op, b.value)
    if isinstance(a, Literal) and isinstance(b, ColumnRef) and a.value is not None:
        return Compare(b.name, MIRRORED.get(n.op, n.op), a.value)
    return None


def _read(e: Expr, scope: object) -> set[int]:
    """Positions of the columns of a scope that an expression reads."""
    n = e.node
    if isinstance(n, ColumnRef):
        return {n.index} if n.scope is scope else set()
    if isinstance(n, UnaryNode):
        return _read(n.child, scope)
    return _read(n.left, scope) | _read(n.right, scope) if isinstance(n, BinaryNode) else set()


def columns_read(plan: N.Plan) -> dict[str, tuple[str, ...]]:
    """Of each source id the columns that the plan reads, in the order of its schema."""
    found: dict[str, tuple[N.Source, set[int]]] = {}

    def visit(p: N.Plan, wanted: set[int]) -> None:
        match p:
            case N.Source():
                found.setdefault(p.ref.id, (p, set()))[1].update(wanted)
            case N.Project():
                visit(p.input, set().union(*(_read(p.exprs[i][1], p.scope) for i in wanted)))
            case N.Filter():
                visit(p.input, wanted | _read(p.predicate, p.scope))
            case N.Sort():
                visit(p.input, wanted.union(*(_read(k.expr, p.scope) for k in p.keys)))
            case N.Aggregate():
                some = [e for _, e in p.keys] + [a.expr for i, (_, a) in enumerate(p.aggregates, len(p.keys)) if i in wanted and a.expr is not None]
                visit(p.input, set().union(*(_read(e, p.scope) for e in some)))
            case N.Join():
                width, kept = len(p.left.schema), {p.keep[i] for i in wanted}
                visit(p.left, {i for i in kept if i < width} | _read(p.condition, p.left_scope))
                visit(p.right, {i - width for i in kept if i >= width} | _read(p.condition, p.right_scope))
            case _:
                for c in p.children:
                    visit(c, wanted)

    visit(plan, set(range(len(plan.schema))))
    return {i: tuple(f.name for j, f in enumerate(s.schema) if j in wanted) for i, (s, wanted) in found.items()}


def scan_requests(plan: N.Plan, batch_size: int = 1024) -> dict[str, ScanRequest]:
    """One request for each source id. A source that is used several times is asked for all that any use needs: no limit unless
    each use has one, then the largest; a predicate only if all uses have the same."""
    uses: dict[str, list[ScanRequest]] = {}

    def visit(p: N.Plan, limit: int | None, predicate: Portable | None) -> None:
        if isinstance(p, N.Source):
            uses.setdefault(p.ref.id, []).append(ScanRequest(predicate, limit, batch_size))
            return
        for c in p.children:
            direct = isinstance(c, N.Source)
            visit(c, p.count if direct and isinstance(p, N.Limit) else None, portable(p.predicate) if direct and isinstance(p, N.Filter) else None)

    visit(plan, None, None)
    out, read = {}, columns_read(plan)
    for source, asked in uses.items():
        limits = [a.limit for a in asked]
        same = all(a.predicate == asked[0].predicate for a in asked)
        out[source] = ScanRequest(asked[0].predicate if same else None, None if None in limits else max(limits), batch_size, read[source])
    return out
