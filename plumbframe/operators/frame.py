"""Frame: an immutable query with an exact schema. Every verb checks its arguments and returns a new Frame; nothing runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence

from plumbframe.errors import FrameError, SchemaError
from plumbframe.functions.expr import Aggregate, Binary, BinaryNode, ColumnRef, Expr, Nulls, Order, ScopeToken, SortKey, literal
from plumbframe.plans import nodes as N
from plumbframe.types import BOOL, Field, Schema

Named = tuple[str, Expr]


class Row:
    """What a callback gets: the columns of one frame."""

    __slots__ = ("_schema", "_token")

    def __init__(self, schema: Schema, token: ScopeToken):
        self._schema, self._token = schema, token

    def col(self, name: str) -> Expr:
        i = self._schema.index(name)
        if i is None:
            raise FrameError("ColumnNotFound", f"there is no column '{name}'", name=name)
        f = self._schema.fields[i]
        return Expr(ColumnRef(self._token, i, name), f.dtype, f.nullable)

    __getitem__ = col


def _repeated(names: Iterable[str]) -> list[str]:
    return [n for n, k in Counter(names).items() if k > 1]


def _schema(fields: Iterable[Field]) -> Schema:
    try:
        return Schema(fields)
    except SchemaError as e:
        raise FrameError("InvalidSchema", e.message, error=e) from e


class Frame:
    __slots__ = ("plan", "schema", "token")

    def __init__(self, plan: N.Plan, token: ScopeToken | None = None):
        self.plan, self.schema = plan, plan.schema
        self.token = token or ScopeToken()

    # Sources

    @classmethod
    def scan(cls, ref: N.SourceRef, schema: Schema | Iterable[Field]) -> Frame:
        return cls(N.Source(schema if isinstance(schema, Schema) else _schema(schema), ref))

    @classmethod
    def values(cls, ref: N.SourceRef, schema: Schema | Iterable[Field]) -> Frame:
        if ref.kind is not N.SourceKind.VALUES:
            raise FrameError("NotValuesSource", f"source '{ref.id}' is a {ref.kind.value}, not values", id=ref.id, kind=ref.kind)
        return cls.scan(ref, schema)

    @classmethod
    def source(cls, name: str, schema: Schema | Iterable[Field]) -> Frame:
        return cls.scan(N.SourceRef.scan(name), schema)

    # Checks

    @property
    def row(self) -> Row:
        return Row(self.schema, self.token)

    def _own(self, e: object, *others: Frame) -> Expr:
        if not isinstance(e, Expr):
            e = literal(e)
        known = {self.token, *(o.token for o in others)}
        if e.scopes() - known:
            raise FrameError("InvalidExpressionScope", "an expression reads columns of another frame")
        return e

    def _need(self, name: str) -> int:
        i = self.schema.index(name)
        if i is None:
            raise FrameError("ColumnNotFound", f"there is no column '{name}'", name=name)
        return i

    def _requests(self, names: Sequence[str]) -> None:
        if twice := _repeated(names):
            raise FrameError("DuplicateColumnRequests", f"columns are asked for twice: {', '.join(twice)}", names=twice)

    def _project(self, exprs: Sequence[Named]) -> Frame:
        if twice := _repeated(n for n, _ in exprs):
            raise FrameError("DuplicateOutputNames", f"output columns share a name: {', '.join(twice)}", names=twice)
        schema = _schema(Field(n, e.dtype, e.nullable) for n, e in exprs)
        return Frame(N.Project(schema, self.plan, self.token, tuple(exprs)))

    def _all(self) -> list[Named]:
        return [(n, self.row[n]) for n in self.schema.names]

    # Projections

    def select(self, *columns: str | Expr | Named | Callable[[Row], Expr | Named | Sequence[Expr | Named]]) -> Frame:
        """Names, columns, (name, expression) pairs, or callbacks that make them from the row."""
        out: list[Named] = []
        for c in columns:
            made = c(self.row) if callable(c) else c
            for x in made if isinstance(made, list) else [made]:
                if isinstance(x, str):
                    out.append((x, self.row[x]))
                elif isinstance(x, Expr):
                    if x.column_name is None:
                        raise FrameError("InvalidColumnReference", "a computed column needs a name; use as_", name="", index=len(out))
                    out.append((x.column_name, self._own(x)))
                else:
                    out.append((x[0], self._own(x[1])))
        return self._project(out)

    def with_column(self, name: str, f: Callable[[Row], Expr]) -> Frame:
        """Append a column; a name that is there already is an error."""
        if self.schema.index(name) is not None:
            raise FrameError("ColumnCollision", f"column '{name}' is there already", name=name)
        return self._project([*self._all(), (name, self._own(f(self.row)))])

    def rename(self, old: str, new: str) -> Frame:
        self._need(old)
        if new != old and self.schema.index(new) is not None:
            raise FrameError("ColumnCollision", f"column '{new}' is there already", name=new)
        return self.rename_all((old, new))

    def rename_all(self, *pairs: tuple[str, str]) -> Frame:
        """All at once against the columns as they are, so names can be swapped."""
        self._requests([a for a, _ in pairs])
        for old, _ in pairs:
            self._need(old)
        to = dict(pairs)
        return self._project([(to.get(n, n), e) for n, e in self._all()])

    def drop(self, name: str) -> Frame:
        self._need(name)
        return self._project([(n, e) for n, e in self._all() if n != name])

    def drop_all(self, *names: str) -> Frame:
        if not names:
            raise FrameError("DuplicateColumnRequests", "no column is named to drop", names=[])
        self._requests(names)
        for n in names:
            self._need(n)
        return self._project([(n, e) for n, e in self._all() if n not in names])

    def replace(self, name: str, f: Callable[[Row], Expr]) -> Frame:
        return self.replace_all({name: f})

    def replace_all(self, made: Mapping[str, Callable[[Row], Expr]]) -> Frame:
        """New values, of any type, in place; all see the row as it was."""
        for n in made:
            self._need(n)
        return self._project([(n, self._own(made[n](self.row)) if n in made else e) for n, e in self._all()])

    # Rows

    def filter(self, f: Callable[[Row], Expr]) -> Frame:
        p = self._own(f(self.row))
        if p.dtype != BOOL:
            raise FrameError("ExpressionType", f"a predicate is Bool, not {p.dtype}", expected=BOOL, actual=p.dtype)
        if p.nullable:
            raise FrameError("NullablePredicate", "a predicate can be null; end it with is_true() or is_false()")
        return Frame(N.Filter(self.schema, self.plan, self.token, p))

    def limit(self, n: int) -> Frame:
        if n < 0:
            raise FrameError("InvalidLimit", f"a limit can't be {n}", count=n)
        return Frame(N.Limit(self.schema, self.plan, n))

    def sort_by(self, *keys: Callable[[Row], Expr | SortKey] | str, order: Order = Order.ASCENDING, nulls: Nulls = Nulls.LAST) -> Frame:
        """Keys of their own direction, or expressions that share order and nulls. Stable where the input has an order."""
        if not keys:
            raise FrameError("EmptySort", "a sort needs a key")
        made = [self.row[k] if isinstance(k, str) else k(self.row) for k in keys]
        made = [k if isinstance(k, SortKey) else SortKey(k, order, nulls) for k in made]
        for k in made:
            self._own(k.expr)
        return Frame(N.Sort(self.schema, self.plan, self.token, tuple(made)))

    def union_all(self, right: Frame) -> Frame:
        if issues := self.schema.issues(right.schema):
            raise FrameError("SchemaMismatch", "; ".join(i.message for i in issues), issues=issues)
        return Frame(N.UnionAll(self.schema, self.plan, right.plan))

    # Groups

    def group_by(self, *keys: str | Named | Callable[[Row], Expr | Named]) -> GroupedFrame:
        out: list[Named] = []
        for k in keys:
            x = k(self.row) if callable(k) else k
            if isinstance(x, str):
                out.append((x, self.row[x]))
            elif isinstance(x, Expr):
                if x.column_name is None:
                    raise FrameError("InvalidColumnReference", "a computed key needs a name; use as_", name="", index=len(out))
                out.append((x.column_name, self._own(x)))
            else:
                out.append((x[0], self._own(x[1])))
        return GroupedFrame(self, tuple(out))

    def distinct(self) -> Frame:
        return Frame(N.Aggregate(self.schema, self.plan, self.token, tuple(self._all()), (), True))

    # Joins

    def inner_join(self, right: Frame, on: Callable[[Row, Row], Expr]) -> Frame:
        return self._join(right, on, N.JoinKind.INNER)

    def left_join(self, right: Frame, on: Callable[[Row, Row], Expr]) -> Frame:
        return self._join(right, on, N.JoinKind.LEFT_OUTER)

    def right_join(self, right: Frame, on: Callable[[Row, Row], Expr]) -> Frame:
        return self._join(right, on, N.JoinKind.RIGHT_OUTER)

    def semi_join(self, right: Frame, on: Callable[[Row, Row], Expr]) -> Frame:
        return self._join(right, on, N.JoinKind.LEFT_SEMI)

    def anti_join(self, right: Frame, on: Callable[[Row, Row], Expr]) -> Frame:
        return self._join(right, on, N.JoinKind.LEFT_ANTI)

    def _join(self, right: Frame, on: Callable[[Row, Row], Expr], kind: N.JoinKind) -> Frame:
        # A frame joined with itself has two scopes.
        left_scope, right_scope = (self.token, right.token) if self.token is not right.token else (ScopeToken(), ScopeToken())
        e = on(Row(self.schema, left_scope), Row(right.schema, right_scope))
        if not isinstance(e, Expr):
            e = literal(e)
        if e.scopes() - {left_scope, right_scope}:
            raise FrameError("InvalidExpressionScope", "a join condition reads columns of another frame")
        if e.dtype != BOOL:
            raise FrameError("ExpressionType", f"a join condition is Bool, not {e.dtype}", expected=BOOL, actual=e.dtype)
        width = len(self.schema)
        if kind in (N.JoinKind.LEFT_SEMI, N.JoinKind.LEFT_ANTI):
            return Frame(N.Join(self.schema, self.plan, right.plan, left_scope, right_scope, kind, e, tuple(range(width))))
        for n in self.schema.names:
            if right.schema.index(n) is not None:
                raise FrameError("ColumnCollision", f"column '{n}' is on both sides", name=n)
        return self._joined(right, left_scope, right_scope, kind, e, tuple(range(width + len(right.schema))))

    def _joined(self, right: Frame, left_scope: ScopeToken, right_scope: ScopeToken, kind: N.JoinKind, e: Expr, keep: tuple[int, ...]) -> Frame:
        loose_left, loose_right = kind is N.JoinKind.RIGHT_OUTER, kind is N.JoinKind.LEFT_OUTER
        fields = [Field(f.name, f.dtype, f.nullable or loose_left) for f in self.schema] + [Field(f.name, f.dtype, f.nullable or loose_right) for f in right.schema]
        return Frame(N.Join(_schema(fields[i] for i in keep), self.plan, right.plan, left_scope, right_scope, kind, e, keep))

    def inner_join_using(self, right: Frame, *keys: str) -> Frame:
        return self._using(right, keys, N.JoinKind.INNER)

    def left_join_using(self, right: Frame, *keys: str) -> Frame:
        return self._using(right, keys, N.JoinKind.LEFT_OUTER)

    def _using(self, right: Frame, keys: Sequence[str], kind: N.JoinKind) -> Frame:
        if not keys:
            raise FrameError("EmptyJoinKeys", "a using join needs a key")
        if twice := _repeated(keys):
            raise FrameError("DuplicateJoinKey", f"key '{twice[0]}' occurs twice", name=twice[0])
        a, b = ScopeToken(), ScopeToken()
        left_row, right_row = Row(self.schema, a), Row(right.schema, b)
        condition: Expr | None = None
        for k in keys:
            x, y = left_row[k], right_row[k]
            if x.dtype != y.dtype:
                raise FrameError("JoinKeyType", f"key '{k}' is {x.dtype} on the left and {y.dtype} on the right", name=k, left=x.dtype, right=y.dtype)
            same = x.eq(y).is_true()
            condition = same if condition is None else Expr(BinaryNode(Binary.AND, condition, same), BOOL, False)
        width = len(self.schema)
        rest = [i for i, f in enumerate(right.schema) if f.name not in keys]
        for i in rest:
            if self.schema.index(right.schema.fields[i].name) is not None:
                raise FrameError("ColumnCollision", f"column '{right.schema.fields[i].name}' is on both sides", name=right.schema.fields[i].name)
        return self._joined(right, a, b, kind, condition, (*range(width), *(width + i for i in rest)))

    # Inspection

    def typed(self, schema: Schema) -> Frame:
        """This frame, if its schema is exactly the one given."""
        if issues := schema.issues(self.schema):
            raise FrameError("SchemaMismatch", "; ".join(i.message for i in issues), issues=issues)
        return Frame(self.plan, self.token)

    def dynamic(self) -> Frame:
        return self

    def normalized(self) -> Frame:
        """This frame: rewriting is Catalyst's."""
        return self

    def explain(self) -> str:
        return N.explain(self.plan)

    def __repr__(self) -> str:
        return f"Frame({self.schema!r})"


class GroupedFrame:
    __slots__ = ("_frame", "_keys")

    def __init__(self, frame: Frame, keys: tuple[Named, ...]):
        self._frame, self._keys = frame, keys

    def aggregate(self, *aggregates: tuple[str, Aggregate] | Callable[[Row], tuple[str, Aggregate] | Sequence[tuple[str, Aggregate]]]) -> Frame:
        f = self._frame
        made: list[tuple[str, Aggregate]] = []
        for a in aggregates:
            x = a(f.row) if callable(a) else a
            made += x if isinstance(x, list) else [x]
        for _, a in made:
            if a.expr is not None:
                f._own(a.expr)
        if twice := _repeated([n for n, _ in self._keys] + [n for n, _ in made]):
            raise FrameError("DuplicateOutputNames", f"output columns share a name: {', '.join(twice)}", names=twice)
        fields = [Field(n, e.dtype, e.nullable) for n, e in self._keys] + [Field(n, a.dtype, a.nullable) for n, a in made]
        return Frame(N.Aggregate(_schema(fields), f.plan, f.token, self._keys, tuple(made)))
