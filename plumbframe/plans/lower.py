"""Lowering of plans to Spark DataFrames.

Columns are named by position inside (c0, c1, ...), so names never clash, self-joins resolve, and any name is possible. Predicates of filters and
joins are lowered in a form that Catalyst can push down and use for equi-joins; values are lowered with exact three-valued logic.
The semantic differences to Spark are encoded here: NaN is unequal to itself, division of floats follows IEEE, integers keep their width and
raise on overflow, minima propagate NaN, and -0.0 sorts before 0.0 unless strict_zero is off.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbframe.functions.expr import ORDERING, Aggregate, Binary, BinaryNode, ColumnRef, Expr, Literal, Nulls, Order, Reduce, ScopeToken, SortKey, Unary, UnaryNode
from plumbframe.plans import nodes as N
from plumbframe.types import FLOAT32, INT32, DataType

#: Of each scope the columns of its rows.
Columns = dict[ScopeToken, list[Column]]


@dataclass(frozen=True)
class Lowering:
    """strict_zero: tell -0.0 from 0.0 in comparisons, sorts and extrema. Comparisons with literals other than 0 stay as they are, and reach the scan."""

    strict_zero: bool = True

    # Expressions

    def value(self, e: Expr, at: Columns) -> Column:
        """The exact value of e."""
        n = e.node
        match n:
            case ColumnRef():
                return at[n.scope][n.index]
            case Literal():
                return _literal(n.value, e.dtype)
            case UnaryNode():
                return self._unary(n, e.dtype, at)
            case BinaryNode():
                return self._binary(n, e.dtype, at)

    def predicate(self, e: Expr, at: Columns) -> Column:
        """A condition that is true just where e is; elsewhere it may be false or null."""
        n = e.node
        if isinstance(n, UnaryNode) and n.op is Unary.IS_TRUE:
            return self.predicate(n.child, at)
        if isinstance(n, BinaryNode):
            if n.op is Binary.AND:
                return self.predicate(n.left, at) & self.predicate(n.right, at)
            if n.op is Binary.OR:
                return self.predicate(n.left, at) | self.predicate(n.right, at)
            if n.op is Binary.EQ and n.left.dtype.is_floating:
                a, b = self.value(n.left, at), self.value(n.right, at)
                return (a == b) & ~F.isnan(a) & ~F.isnan(b)
        return self.value(e, at)

    def _unary(self, n: UnaryNode, dtype: DataType, at: Columns) -> Column:
        x = self.value(n.child, at)
        match n.op:
            case Unary.NEGATE:
                return -x
            case Unary.SQRT:
                return F.sqrt(x).cast("float") if dtype == FLOAT32 else F.sqrt(x)
            case Unary.IS_NULL:
                return x.isNull()
            case Unary.IS_NOT_NULL:
                return x.isNotNull()
            case Unary.IS_TRUE:
                return F.coalesce(x, F.lit(False))
            case Unary.IS_FALSE:
                return F.coalesce(~x, F.lit(False))

    def _binary(self, n: BinaryNode, dtype: DataType, at: Columns) -> Column:
        a, b, operands = self.value(n.left, at), self.value(n.right, at), n.left.dtype
        floats = operands.is_floating
        match n.op:
            case Binary.ADD:
                return a + b
            case Binary.SUB:
                return a - b
            case Binary.MUL:
                return a * b
            case Binary.DIV:
                return _ieee_division(a, b, dtype) if floats else _integer_division(a, b, dtype)
            case Binary.EQ | Binary.NE:
                # NaN against null is null, as any comparison with null.
                same = F.when(F.isnan(a) & b.isNotNull(), F.lit(False)).otherwise(a == b) if floats else a == b
                return same if n.op is Binary.EQ else ~same
            case Binary.NULL_SAFE_EQ:
                return a.eqNullSafe(b) & ~F.coalesce(F.isnan(a), F.lit(False)) if floats else a.eqNullSafe(b)
            case Binary.AND:
                return a & b
            case Binary.OR:
                return a | b
        if floats and self.strict_zero and n.op in ORDERING and not any(isinstance(x.node, Literal) and x.node.value != 0 for x in (n.left, n.right)):
            return self._strict(n.op, a, b)
        return {Binary.LT: a < b, Binary.LE: a <= b, Binary.GT: a > b, Binary.GE: a >= b}[n.op]

    def _strict(self, op: Binary, a: Column, b: Column) -> Column:
        if op in (Binary.GT, Binary.GE):
            a, b, op = b, a, Binary.LT if op is Binary.GT else Binary.LE
        zeros = (a == 0) & (b == 0)
        if op is Binary.LT:
            return (a < b) | (zeros & _negative_zero(a) & ~_negative_zero(b))
        return F.when(zeros, _negative_zero(a) | ~_negative_zero(b)).otherwise(a <= b)

    # Aggregates and sort keys

    def aggregate(self, a: Aggregate, at: Columns) -> Column:
        if a.op is Reduce.COUNT:
            return F.count(F.lit(1))
        x, t = self.value(a.expr, at), a.expr.dtype
        match a.op:
            case Reduce.SUM:
                if t == INT32:
                    return F.sum(x).cast("int")
                return F.sum(x.cast("double")).cast("float") if t == FLOAT32 else F.sum(x)
            case Reduce.MEAN:
                return F.avg(x.cast("double"))
            case Reduce.VARIANCE_POP:
                return F.var_pop(x.cast("double"))
            case Reduce.STDDEV_POP:
                return F.stddev_pop(x.cast("double"))
            case Reduce.MIN:
                if not t.is_floating:
                    return F.min(x)
                low = F.min(x)
                if self.strict_zero:
                    low = F.when((low == 0) & F.max((x == 0) & _negative_zero(x)), -F.abs(low)).otherwise(low)
                return F.when(F.max(F.isnan(x)), F.lit(float("nan")).cast(t.to_spark())).otherwise(low.cast(t.to_spark()))
            case Reduce.MAX:
                if not (t.is_floating and self.strict_zero):
                    return F.max(x)
                high = F.max(x)
                positive = F.max((x == 0) & ~_negative_zero(x))
                # Not literals: Spark takes 0.0 and -0.0 for the same one.
                return F.when(high == 0, F.when(positive, F.abs(high)).otherwise(-F.abs(high))).otherwise(high)

    def sort_columns(self, k: SortKey, at: Columns) -> list[Column]:
        def ordered(c: Column) -> Column:
            if k.order is Order.ASCENDING:
                return c.asc_nulls_first() if k.nulls is Nulls.FIRST else c.asc_nulls_last()
            return c.desc_nulls_first() if k.nulls is Nulls.FIRST else c.desc_nulls_last()

        x = self.value(k.expr, at)
        out = [ordered(x)]
        if self.strict_zero and k.expr.dtype.is_floating:
            sign = (x == 0) & ~_negative_zero(x)
            out.append(sign.asc() if k.order is Order.ASCENDING else sign.desc())
        return out

    # Nodes

    def lower(self, plan: N.Plan, bound: Callable[[N.Source], DataFrame]) -> DataFrame:
        """A DataFrame whose columns are c0, c1, ... in the order of plan.schema."""
        match plan:
            case N.Source():
                df = bound(plan)
                return df.select(*[F.col(_quoted(f.name)).alias(f"c{i}") for i, f in enumerate(plan.schema)])
            case N.Project():
                df = self.lower(plan.input, bound)
                at = {plan.scope: _columns(df)}
                return df.select(*[self.value(e, at).alias(f"c{i}") for i, (_, e) in enumerate(plan.exprs)])
            case N.Filter():
                df = self.lower(plan.input, bound)
                return df.filter(self.predicate(plan.predicate, {plan.scope: _columns(df)}))
            case N.Join():
                return self._join(plan, bound)
            case N.UnionAll():
                return self.lower(plan.left, bound).union(self.lower(plan.right, bound))
            case N.Aggregate():
                return self._group(plan, bound)
            case N.Sort():
                df = self.lower(plan.input, bound)
                at = {plan.scope: _columns(df)}
                keys = [c for k in plan.keys for c in self.sort_columns(k, at)]
                if plan.input.order is N.Ordering.UNSPECIFIED:
                    return df.orderBy(*keys)
                # Stable where the rows had an order: their position decides ties.
                return df.withColumn("_at", F.monotonically_increasing_id()).orderBy(*keys, "_at").drop("_at")
            case N.Limit():
                return self.lower(plan.input, bound).limit(plan.count)

    def _join(self, plan: N.Join, bound: Callable[[N.Source], DataFrame]) -> DataFrame:
        left, right = self.lower(plan.left, bound), self.lower(plan.right, bound)
        width = len(plan.left.schema)
        left, right = left.toDF(*[f"l{i}" for i in range(width)]), right.toDF(*[f"r{i}" for i in range(len(plan.right.schema))])
        lc, rc = [F.col(c) for c in left.columns], [F.col(c) for c in right.columns]
        condition = self.predicate(plan.condition, {plan.left_scope: lc, plan.right_scope: rc})
        kind = {N.JoinKind.INNER: "inner", N.JoinKind.LEFT_OUTER: "left", N.JoinKind.RIGHT_OUTER: "right", N.JoinKind.LEFT_SEMI: "left_semi", N.JoinKind.LEFT_ANTI: "left_anti"}[plan.kind]
        joined = left.join(right, condition, kind)
        both = lc + rc
        return joined.select(*[both[i].alias(f"c{j}") for j, i in enumerate(plan.keep)])

    def _group(self, plan: N.Aggregate, bound: Callable[[N.Source], DataFrame]) -> DataFrame:
        df = self.lower(plan.input, bound)
        at = {plan.scope: _columns(df)}
        keys = [self.value(e, at).alias(f"c{i}") for i, (_, e) in enumerate(plan.keys)]
        if plan.distinct and not keys:
            # Without columns there is one group, on empty input too.
            return df.agg(F.count(F.lit(1)).alias("_n")).select()
        aggregates = [self.aggregate(a, at).alias(f"c{len(keys) + i}") for i, (_, a) in enumerate(plan.aggregates)]
        if not aggregates:
            return df.select(*keys).distinct() if keys else df.agg(F.count(F.lit(1)).alias("_n")).select()
        return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)

    def named(self, plan: N.Plan, bound: Callable[[N.Source], DataFrame]) -> DataFrame:
        """lower, with the names of the schema."""
        df = self.lower(plan, bound)
        return df.toDF(*plan.schema.names) if len(plan.schema) else df


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in df.columns]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(value: object, dtype: DataType) -> Column:
    if dtype.name == "Timestamp" and isinstance(value, int) and dtype.to_spark().typeName() == "timestamp_ntz":
        return F.timestamp_micros(F.lit(value)).cast("timestamp_ntz")
    return F.lit(value).cast(dtype.to_spark())


def _negative_zero(x: Column) -> Column:
    """Whether x is -0.0: the only zero whose reciprocal is below 0."""
    return (x == 0) & (F.pow(x, F.lit(-1.0)) < 0)


def _integer_division(a: Column, b: Column, dtype: DataType) -> Column:
    return F.call_function("div", a, b).cast("int") if dtype == INT32 else F.call_function("div", a, b)


def _ieee_division(a: Column, b: Column, dtype: DataType) -> Column:
    """Infinities and NaN instead of errors for a divisor of 0."""
    x, y = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when((x > 0) != _negative_zero(y), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    out = F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y != 0, F.try_divide(x, y)).otherwise(by_zero)
    return out.cast(dtype.to_spark())


