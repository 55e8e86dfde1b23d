"""The closed expression algebra: columns, literals, 6 unary and 13 binary operators, 7 aggregates.

Types are checked when an expression is built; there are no casts and no coercions. Every expression knows its type,
whether it can be null, and the scopes (frames) whose columns it reads.
"""

from __future__ import annotations

import datetime
import struct
from dataclasses import dataclass
from enum import Enum

from plumbframe.errors import FrameError
from plumbframe.types import BOOL, FLOAT64, INT64, TIMESTAMP, UTF8, DataType, TimeUnit


class ScopeToken:
    """The identity of a frame; equal schemas don't make equal scopes."""

    __slots__ = ()


class Unary(Enum):
    NEGATE = "negate"
    SQRT = "sqrt"
    IS_NULL = "isNull"
    IS_NOT_NULL = "isNotNull"
    IS_TRUE = "isTrue"
    IS_FALSE = "isFalse"


class Binary(Enum):
    ADD = "+"
    SUB = "-"
    MUL = "*"
    DIV = "/"
    EQ = "==="
    NE = "=!="
    NULL_SAFE_EQ = "nullSafeEq"
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="
    AND = "&&"
    OR = "||"


ARITHMETIC = {Binary.ADD, Binary.SUB, Binary.MUL, Binary.DIV}
LOGIC = {Binary.AND, Binary.OR}
ORDERING = {Binary.LT, Binary.LE, Binary.GT, Binary.GE}


@dataclass(frozen=True)
class ColumnRef:
    scope: ScopeToken
    index: int
    name: str


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class UnaryNode:
    op: Unary
    child: Expr


@dataclass(frozen=True)
class BinaryNode:
    op: Binary
    left: Expr
    right: Expr


@dataclass(frozen=True, eq=False)
class Expr:
    node: ColumnRef | Literal | UnaryNode | BinaryNode
    dtype: DataType
    nullable: bool

    def same(self, other: Expr) -> bool:
        """Structural equality (== builds no comparison here: use eq)."""
        return isinstance(other, Expr) and self.key() == other.key()

    def key(self) -> tuple:
        n = self.node
        if isinstance(n, ColumnRef):
            return ("column", id(n.scope), n.index)
        if isinstance(n, Literal):
            bits = struct.pack("<d", n.value) if isinstance(n.value, float) else n.value
            return ("literal", str(self.dtype), type(n.value).__name__, bits)
        if isinstance(n, UnaryNode):
            return (n.op.value, n.child.key())
        return (n.op.value, n.left.key(), n.right.key())

    def scopes(self) -> set[ScopeToken]:
        n = self.node
        if isinstance(n, ColumnRef):
            return {n.scope}
        if isinstance(n, UnaryNode):
            return n.child.scopes()
        return n.left.scopes() | n.right.scopes() if isinstance(n, BinaryNode) else set()

    @property
    def column_name(self) -> str | None:
        return self.node.name if isinstance(self.node, ColumnRef) else None

    def as_(self, name: str) -> tuple[str, Expr]:
        return name, self

    # Operators. Python values on the right become literals of this type.

    def _with(self, op: Binary, other: object) -> Expr:
        other = other if isinstance(other, Expr) else literal(other, self.dtype)
        a, b = self.dtype, other.dtype
        ok = a == b and (a.is_numeric if op in ARITHMETIC else a == BOOL if op in LOGIC else True)
        if not ok:
            raise FrameError("UnsupportedBinaryExpression", f"{op.value} can't take {a} and {b}", operator=op, left=a, right=b)
        result = a if op in ARITHMETIC else BOOL
        return Expr(BinaryNode(op, self, other), result, op is not Binary.NULL_SAFE_EQ and (self.nullable or other.nullable))

    def _one(self, op: Unary, ok: bool, dtype: DataType, nullable: bool) -> Expr:
        if not ok:
            raise FrameError("UnsupportedUnaryExpression", f"{op.value} can't take {self.dtype}", operator=op, actual=self.dtype)
        return Expr(UnaryNode(op, self), dtype, nullable)

    def __add__(self, o: object) -> Expr:
        return self._with(Binary.ADD, o)

    def __sub__(self, o: object) -> Expr:
        return self._with(Binary.SUB, o)

    def __mul__(self, o: object) -> Expr:
        return self._with(Binary.MUL, o)

    def __truediv__(self, o: object) -> Expr:
        return self._with(Binary.DIV, o)

    def __lt__(self, o: object) -> Expr:
        return self._with(Binary.LT, o)

    def __le__(self, o: object) -> Expr:
        return self._with(Binary.LE, o)

    def __gt__(self, o: object) -> Expr:
        return self._with(Binary.GT, o)

    def __ge__(self, o: object) -> Expr:
        return self._with(Binary.GE, o)

    def __and__(self, o: object) -> Expr:
        return self._with(Binary.AND, o)

    def __or__(self, o: object) -> Expr:
        return self._with(Binary.OR, o)

    def eq(self, o: object) -> Expr:
        return self._with(Binary.EQ, o)

    def ne(self, o: object) -> Expr:
        return self._with(Binary.NE, o)

    def null_safe_eq(self, o: object) -> Expr:
        return self._with(Binary.NULL_SAFE_EQ, o)

    def __neg__(self) -> Expr:
        return self._one(Unary.NEGATE, self.dtype.is_numeric, self.dtype, self.nullable)

    def sqrt(self) -> Expr:
        return self._one(Unary.SQRT, self.dtype.is_floating, self.dtype, self.nullable)

    def is_null(self) -> Expr:
        return self._one(Unary.IS_NULL, True, BOOL, False)

    def is_not_null(self) -> Expr:
        return self._one(Unary.IS_NOT_NULL, True, BOOL, False)

    def is_true(self) -> Expr:
        return self._one(Unary.IS_TRUE, self.dtype == BOOL, BOOL, False)

    def is_false(self) -> Expr:
        return self._one(Unary.IS_FALSE, self.dtype == BOOL, BOOL, False)

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use &, | and is_true()")

    # Sort keys.

    def asc(self, nulls: Nulls | None = None) -> SortKey:
        return SortKey(self, Order.ASCENDING, nulls or Nulls.LAST)

    def desc(self, nulls: Nulls | None = None) -> SortKey:
        return SortKey(self, Order.DESCENDING, nulls or Nulls.LAST)


def literal(value: object, dtype: DataType | None = None) -> Expr:
    """A literal of dtype, or of the type that the Python value has: int is Int64, float is Float64."""
    if value is None:
        raise FrameError("ExpressionType", "a null literal needs a type; use null_literal")
    if dtype is None:
        dtype = BOOL if isinstance(value, bool) else INT64 if isinstance(value, int) else FLOAT64 if isinstance(value, float) else UTF8 if isinstance(value, str) else TIMESTAMP if isinstance(value, datetime.datetime) else None
        if dtype is None:
            raise FrameError("ExpressionType", f"{type(value).__name__} is no literal of this algebra")
    ok = {
        "Bool": lambda v: isinstance(v, bool),
        "Int32": lambda v: isinstance(v, int) and not isinstance(v, bool) and -(2**31) <= v < 2**31,
        "Int64": lambda v: isinstance(v, int) and not isinstance(v, bool) and -(2**63) <= v < 2**63,
        "Float32": lambda v: isinstance(v, float),
        "Float64": lambda v: isinstance(v, float),
        "Utf8": lambda v: isinstance(v, str),
        "Timestamp": lambda v: isinstance(v, datetime.datetime) and v.tzinfo is None and dtype.unit is TimeUnit.MICROSECOND or isinstance(v, int) and not isinstance(v, bool),
    }[dtype.name]
    if not ok(value):
        raise FrameError("ExpressionType", f"a {type(value).__name__} is no literal of type {dtype}", expected=dtype)
    return Expr(Literal(value), dtype, False)


def null_literal(dtype: DataType) -> Expr:
    return Expr(Literal(None), dtype, True)


class Order(Enum):
    ASCENDING = "Ascending"
    DESCENDING = "Descending"


class Nulls(Enum):
    FIRST = "First"
    LAST = "Last"


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    order: Order = Order.ASCENDING
    nulls: Nulls = Nulls.LAST


def asc(e: Expr, nulls: Nulls | None = None) -> SortKey:
    return e.asc(nulls)


def desc(e: Expr, nulls: Nulls | None = None) -> SortKey:
    return e.desc(nulls)


class Reduce(Enum):
    COUNT = "count"
    SUM = "sum"
    MEAN = "mean"
    VARIANCE_POP = "variancePop"
    STDDEV_POP = "stddevPop"
    MIN = "min"
    MAX = "max"


@dataclass(frozen=True)
class Aggregate:
    op: Reduce
    expr: Expr | None
    dtype: DataType
    nullable: bool

    def as_(self, name: str) -> tuple[str, Aggregate]:
        return name, self


def count() -> Aggregate:
    return Aggregate(Reduce.COUNT, None, INT64, False)


def _numeric(op: Reduce, e: Expr, dtype: DataType | None = None) -> Aggregate:
    if not e.dtype.is_numeric:
        raise FrameError("ExpressionType", f"{op.value} takes numbers, not {e.dtype}", expected=FLOAT64, actual=e.dtype)
    return Aggregate(op, e, dtype or e.dtype, True)


def sum_(e: Expr) -> Aggregate:
    return _numeric(Reduce.SUM, e)


def mean(e: Expr) -> Aggregate:
    return _numeric(Reduce.MEAN, e, FLOAT64)


def variance_pop(e: Expr) -> Aggregate:
    return _numeric(Reduce.VARIANCE_POP, e, FLOAT64)


def stddev_pop(e: Expr) -> Aggregate:
    return _numeric(Reduce.STDDEV_POP, e, FLOAT64)


def min_(e: Expr) -> Aggregate:
    return Aggregate(Reduce.MIN, e, e.dtype, True)


def max_(e: Expr) -> Aggregate:
    return Aggregate(Reduce.MAX, e, e.dtype, True)


