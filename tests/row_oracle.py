"""A row-at-a-time interpreter of plans, for tests only: the semantics spelled out in plain Python."""

from __future__ import annotations

import functools
import math

from plumbframe.errors import ExecutionError
from plumbframe.functions.expr import Binary, BinaryNode, ColumnRef, Expr, Literal, Nulls, Order, Reduce, Unary, UnaryNode
from plumbframe.plans import nodes as N


def is_nan(x):
    return isinstance(x, float) and math.isnan(x)


def compare(a, b):
    """The total order: NaN is the greatest, -0.0 comes before 0.0."""
    if isinstance(a, float):
        if is_nan(a) or is_nan(b):
            return is_nan(a) - is_nan(b)
        if a == b == 0:
            return int(math.copysign(1, a) > 0) - int(math.copysign(1, b) > 0)
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    return (a > b) - (a < b)


def checked(x, bits):
    if not -(2 ** (bits - 1)) <= x < 2 ** (bits - 1):
        raise ExecutionError("IntegerOverflow", "overflow")
    return x


def divide(a, b):
    if b != 0:
        try:
            return a / b
        except OverflowError:
            return math.inf
    if is_nan(a) or is_nan(b) or a == 0:
        return math.nan
    return math.copysign(math.inf, a) * math.copysign(1, b)


def evaluate(e: Expr, rows):
    n = e.node
    if isinstance(n, ColumnRef):
        return rows[n.scope][n.index]
    if isinstance(n, Literal):
        return n.value
    if isinstance(n, UnaryNode):
        x = evaluate(n.child, rows)
        if n.op is Unary.IS_NULL:
            return x is None
        if n.op is Unary.IS_NOT_NULL:
            return x is not None
        if n.op is Unary.IS_TRUE:
            return x is True
        if n.op is Unary.IS_FALSE:
            return x is False
        if x is None:
            return None
        if n.op is Unary.NEGATE:
            return -x if isinstance(x, float) else checked(-x, 32 if e.dtype.name == "Int32" else 64)
        return math.nan if is_nan(x) or x < 0 else math.sqrt(x)
    assert isinstance(n, BinaryNode)
    a, b = evaluate(n.left, rows), evaluate(n.right, rows)
    op = n.op
    if op is Binary.AND:
        return False if a is False or b is False else None if a is None or b is None else True
    if op is Binary.OR:
        return True if a is True or b is True else None if a is None or b is None else False
    if op is Binary.NULL_SAFE_EQ:
        return (a is None and b is None) or (a is not None and b is not None and a == b)
    if a is None or b is None:
        return None
    if op is Binary.EQ:
        return a == b
    if op is Binary.NE:
        return a != b
    c = compare(a, b)
    if op in (Binary.LT, Binary.LE, Binary.GT, Binary.GE):
        return {Binary.LT: c < 0, Binary.LE: c <= 0, Binary.GT: c > 0, Binary.GE: c >= 0}[op]
    if isinstance(a, float):
        return {Binary.ADD: lambda: a + b, Binary.SUB: lambda: a - b, Binary.MUL: lambda: a * b, Binary.DIV: lambda: divide(a, b)}[op]()
    bits = 32 if e.dtype.name == "Int32" else 64
    if op is Binary.DIV:
        if b == 0:
            raise ExecutionError("DivisionByZero", "division by zero")
        q = abs(a) // abs(b)
        return checked(q if (a < 0) == (b < 0) else -q, bits)
    return checked({Binary.ADD: a + b, Binary.SUB: a - b, Binary.MUL: a * b}[op], bits)


def key_atom(x):
    return ("nan",) if is_nan(x) else 0.0 if x == 0 and isinstance(x, float) else x


def reduce(a, scope, rows):
    if a.op is Reduce.COUNT:
        return len(rows)
    v = [x for r in rows if (x := evaluate(a.expr, {scope: r})) is not None]
    if not v:
        return None
    if a.op is Reduce.SUM:
        t = a.expr.dtype.name
        return math.fsum(v) if t.startswith("Float") and not any(is_nan(x) or math.isinf(x) for x in v) else sum(v) if t.startswith("Float") else checked(sum(v), 32 if t == "Int32" else 64)
    if a.op is Reduce.MEAN:
        return sum(map(float, v)) / len(v)
    if a.op in (Reduce.VARIANCE_POP, Reduce.STDDEV_POP):
        m = sum(map(float, v)) / len(v)
        var = sum((x - m) ** 2 for x in v) / len(v)
        return var if a.op is Reduce.VARIANCE_POP else math.sqrt(var)
    if any(is_nan(x) for x in v):
        return math.nan
    best = v[0]
    for x in v[1:]:
        c = compare(x, best)
        if c < 0 if a.op is Reduce.MIN else c > 0:
            best = x
    return best


def execute(plan, tables):
    match plan:
        case N.Source():
            return list(tables[plan.ref.id])
        case N.Project():
            return [tuple(evaluate(e, {plan.scope: r}) for _, e in plan.exprs) for r in execute(plan.input, tables)]
        case N.Filter():
            return [r for r in execute(plan.input, tables) if evaluate(plan.predicate, {plan.scope: r}) is True]
        case N.Limit():
            return execute(plan.input, tables)[: plan.count]
        case N.UnionAll():
            return execute(plan.left, tables) + execute(plan.right, tables)
        case N.Sort():
            rows = execute(plan.input, tables)

            def order(r, s):
                for k in plan.keys:
                    a, b = evaluate(k.expr, {plan.scope: r}), evaluate(k.expr, {plan.scope: s})
                    if a is None or b is None:
                        if (a is None) != (b is None):
                            return -1 if (a is None) == (k.nulls is Nulls.FIRST) else 1
                        continue
                    c = compare(a, b)
                    if c:
                        return c if k.order is Order.ASCENDING else -c
                return 0

            return sorted(rows, key=functools.cmp_to_key(order))
        case N.Aggregate():
            groups: dict = {}
            for r in execute(plan.input, tables):
                values = tuple(evaluate(e, {plan.scope: r}) for _, e in plan.keys)
                groups.setdefault(tuple(map(key_atom, values)), (values, []))[1].append(r)
            if not plan.keys:
                groups.setdefault((), ((), []))
            return [values + tuple(reduce(a, plan.scope, rows) for _, a in plan.aggregates) for values, rows in groups.values()]
        case N.Join():
            left, right = execute(plan.left, tables), execute(plan.right, tables)
            true = lambda l, r: evaluate(plan.condition, {plan.left_scope: l, plan.right_scope: r}) is True  # noqa: E741, E731
            if plan.kind is N.JoinKind.LEFT_SEMI:
                return [l for l in left if any(true(l, r) for r in right)]  # noqa: E741
            if plan.kind is N.JoinKind.LEFT_ANTI:
                return [l for l in left if not any(true(l, r) for r in right)]  # noqa: E741
            nl, nr = (None,) * len(plan.left.schema), (None,) * len(plan.right.schema)
            out = [l + r for l in left for r in right if true(l, r)]  # noqa: E741
            if plan.kind is N.JoinKind.LEFT_OUTER:
                out += [l + nr for l in left if not any(true(l, r) for r in right)]  # noqa: E741
            if plan.kind is N.JoinKind.RIGHT_OUTER:
                out += [nl + r for r in right if not any(true(l, r) for l in left)]  # noqa: E741
            return [tuple(row[i] for i in plan.keep) for row in out]


def canonical(rows, digits=None):
    def atom(x):
        if x is None or isinstance(x, bool | str | int):
            return (type(x).__name__, x if x is not None else 0)
        if isinstance(x, float):
            if is_nan(x):
                return ("float", "nan")
            return ("float", repr(round(x, digits) + 0.0 if digits is not None and not math.isinf(x) else x))
        return (type(x).__name__, repr(x))

    return sorted([tuple(atom(x) for x in r) for r in rows], key=repr)
