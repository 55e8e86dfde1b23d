"""Hand-written expectations for verbs, joins, groups and sorts."""

import datetime
import math

import pytest

from plumbframe import BOOL, FLOAT32, FLOAT64, INT32, INT64, TIMESTAMP, UTF8, Field, Frame, FrameError, Nulls, Order, Schema, SchemaError, SourceRef, TimeUnit, count, literal, max_, mean, min_, null_literal, stddev_pop, sum_, timestamp, variance_pop
from plumbframe.errors import ExecutionError, StorageError

NAN, INF = math.nan, math.inf
A1 = Schema.of(id=INT32, value=(FLOAT64, True), flag=(BOOL, True), label=UTF8)
ROWS1 = [(1, 1.0, True, "a"), (2, None, None, "b"), (3, NAN, False, "c"), (4, 1.0, True, "d")]


def fails(code, f):
    with pytest.raises(FrameError) as e:
        f()
    assert e.value.code == code
    assert len(e.value.message) <= 256


def test_filter_and_three_valued_logic(run):
    assert [r[0] for r in run(lambda s: s.filter(lambda r: r["flag"].is_true()), (A1, ROWS1))] == [1, 4]
    assert [r[0] for r in run(lambda s: s.filter(lambda r: r["flag"].is_false()), (A1, ROWS1))] == [3]
    assert [r[0] for r in run(lambda s: s.filter(lambda r: r["value"].is_null()), (A1, ROWS1))] == [2]
    truth = Schema.of(a=(BOOL, True), b=(BOOL, True))
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    got = run(lambda s: s.select("a", "b", lambda r: (r["a"] & r["b"]).as_("x"), lambda r: (r["a"] | r["b"]).as_("y")), (truth, rows))
    for a, b, x, y in got:
        assert x == (False if a is False or b is False else None if a is None or b is None else True)
        assert y == (True if a is True or b is True else None if a is None or b is None else False)


def test_nan_equality_and_order(run):
    s = Schema.of(a=(FLOAT64, True), b=(FLOAT64, True))
    rows = [(NAN, NAN), (NAN, 1.0), (1.0, NAN), (NAN, None), (None, None), (0.0, -0.0), (-0.0, 0.0)]
    got = run(lambda f: f.select(lambda r: r["a"].eq(r["b"]).as_("eq"), lambda r: r["a"].ne(r["b"]).as_("ne"), lambda r: r["a"].null_safe_eq(r["b"]).as_("ns"), lambda r: (r["a"] >= r["b"]).as_("ge"), lambda r: (r["a"] < r["b"]).as_("lt")), (s, rows), strict_zero=True)
    assert got == [(False, True, False, True, False), (False, True, False, True, False), (False, True, False, False, True), (None, None, False, None, None), (None, None, True, None, None), (True, False, True, True, False), (True, False, True, False, True)]
    assert run(lambda f: f.filter(lambda r: r["a"].eq(r["b"]).is_true()), (s, rows[:5])) == []


def test_integers_are_checked(run):
    s = Schema.of(i=INT32, d=INT32, l=INT64, m=INT64)
    got = run(lambda f: f.select(lambda r: (r["i"] / r["d"]).as_("x"), lambda r: (r["l"] / r["m"]).as_("y")), (s, [(7, 2, -7, 2), (-7, 2, 7, -2)]))
    assert got == [(3, -3), (-3, -3)]
    big, lowest = 2**31 - 1, -(2**31)
    for rows, f, code in [
        ([(1, 0, 1, 1)], lambda r: r["i"] / r["d"], "DivisionByZero"),
        ([(1, 1, 1, 0)], lambda r: r["l"] / r["m"], "DivisionByZero"),
        ([(lowest, -1, 1, 1)], lambda r: r["i"] / r["d"], "IntegerOverflow"),
        ([(1, 1, -(2**63), -1)], lambda r: r["l"] / r["m"], "IntegerOverflow"),
        ([(big, 1, 1, 1)], lambda r: r["i"] + r["d"], "IntegerOverflow"),
        ([(big, 2, 1, 1)], lambda r: r["i"] * r["d"], "IntegerOverflow"),
        ([(lowest, 1, 1, 1)], lambda r: -r["i"], "IntegerOverflow"),
        ([(1, 1, 2**63 - 1, 1)], lambda r: r["l"] + r["m"], "IntegerOverflow"),
    ]:
        with pytest.raises(ExecutionError) as e:
            run(lambda s_, f=f: s_.select(lambda r: f(r).as_("x")), (s, rows))
        assert e.value.code == code
    # A filter keeps the row that would overflow from what follows.
    assert run(lambda f: f.filter(lambda r: r["d"] > literal(0, INT32)).filter(lambda r: (r["i"] + literal(1, INT32)) > literal(0, INT32)), (s, [(big, 0, 1, 1), (1, 1, 1, 1)])) == [(1, 1, 1, 1)]


def test_float_division_and_roots(run):
    s = Schema.of(a=FLOAT64, b=FLOAT64, f=FLOAT32)
    got = run(lambda x: x.select(lambda r: (r["a"] / r["b"]).as_("q"), lambda r: r["a"].sqrt().as_("s"), lambda r: (r["f"] / literal(3.0, FLOAT32)).as_("f")), (s, [(1.0, 0.0, 1.0), (1.0, -0.0, 1.0), (-1.0, 0.0, 1.0), (0.0, 0.0, 1.0), (NAN, 0.0, 1.0), (4.0, 2.0, 1.0)]))
    assert [r[0] for r in got[:3]] == [INF, -INF, -INF] and math.isnan(got[3][0]) and math.isnan(got[4][0]) and got[5][0] == 2.0
    assert got[0][1] == 1.0 and math.isnan(got[2][1]) and got[5][1] == 2.0
    assert got[0][2] == pytest.approx(1 / 3, rel=1e-6)


def test_projection_verbs(run):
    s = Schema.of(id=INT32, label=UTF8, score=(FLOAT64, True), active=BOOL)
    rows = [(1, "x", None, True)]
    f = Frame.source("t", s)
    assert f.rename("label", "name").schema.names == ("id", "name", "score", "active")
    assert f.rename_all(("id", "label"), ("label", "id")).schema == Schema([Field("label", INT32), Field("id", UTF8), Field("score", FLOAT64, True), Field("active", BOOL)])
    assert f.drop("score").schema.names == ("id", "label", "active")
    assert f.drop_all("id", "active").schema.names == ("label", "score")
    assert f.replace("id", lambda r: r["label"]).schema.fields[0] == Field("id", UTF8)
    assert run(lambda t: t.rename_all(("id", "label"), ("label", "id")), (s, rows)) == [(1, "x", None, True)]
    assert run(lambda t: t.replace_all({"id": lambda r: r["id"] + literal(1, INT32), "label": lambda r: r["id"]}), (s, rows)) == [(2, 1, None, True)]
    assert run(lambda t: t.with_column("more", lambda r: r["score"].is_null()), (s, rows)) == [(1, "x", None, True, True)]
    fails("ColumnCollision", lambda: f.with_column("id", lambda r: r["id"]))
    fails("ColumnCollision", lambda: f.rename("id", "label"))
    fails("ColumnNotFound", lambda: f.rename("no", "x"))
    fails("ColumnNotFound", lambda: f.drop("no"))
    fails("DuplicateColumnRequests", lambda: f.drop_all("id", "id"))
    fails("DuplicateColumnRequests", lambda: f.drop_all())
    fails("DuplicateColumnRequests", lambda: f.rename_all(("id", "a"), ("id", "b")))
    fails("DuplicateOutputNames", lambda: f.rename_all(("id", "a"), ("label", "a")))
    fails("DuplicateOutputNames", lambda: f.select("id", "id"))
    fails("InvalidColumnReference", lambda: f.select(lambda r: r["id"] + literal(1, INT32)))
    fails("ColumnNotFound", lambda: f.replace("no", lambda r: r["id"]))


def test_build_time_checks():
    f = Frame.source("t", Schema.of(i=INT32, l=INT64, b=(BOOL, True), s=UTF8))
    g = Frame.source("t", f.schema)
    fails("UnsupportedBinaryExpression", lambda: f.select(lambda r: (r["i"] + r["l"]).as_("x")))
    fails("UnsupportedBinaryExpression", lambda: f.select(lambda r: (r["s"] + r["s"]).as_("x")))
    fails("UnsupportedUnaryExpression", lambda: f.select(lambda r: r["i"].sqrt().as_("x")))
    fails("UnsupportedUnaryExpression", lambda: f.select(lambda r: r["s"].is_true().as_("x")))
    fails("NullablePredicate", lambda: f.filter(lambda r: r["b"]))
    fails("ExpressionType", lambda: f.filter(lambda r: r["i"]))
    fails("InvalidExpressionScope", lambda: f.filter(lambda r: g.row["i"] > literal(0, INT32)))
    fails("InvalidLimit", lambda: f.limit(-1))
    fails("EmptySort", lambda: f.sort_by())
    fails("NotValuesSource", lambda: Frame.values(SourceRef.scan("x"), f.schema))
    fails("ExpressionType", lambda: f.group_by().aggregate(lambda r: sum_(r["s"]).as_("x")))
    fails("InvalidSourceId", lambda: SourceRef.scan(" "))
    fails("NullSourceId", lambda: SourceRef.scan(None))
    fails("ExpressionType", lambda: literal(2**31, INT32))
    fails("ExpressionType", lambda: literal(1.5, INT64))
    assert f.typed(f.schema).schema == f.schema
    with pytest.raises(FrameError) as e:
        f.typed(Schema.of(i=INT64, l=INT64, b=BOOL, x=UTF8))
    assert [i.kind for i in e.value.details["issues"]] == ["FieldType", "FieldNullability", "FieldName"]
    with pytest.raises(TypeError):
        bool(f.row["b"])


def test_schemas():
    for fields, code in [([Field("a", INT32), Field("a", INT32)], "DuplicateFieldName"), ([Field(" ", INT32)], "EmptyFieldName"), ([None], "NullField"), ([Field(None, INT32)], "NullFieldName"), ([Field("a", None)], "NullFieldType"), ([Field("a", timestamp(None))], "NullTimestampUnit"), (None, "NullFields")]:
        with pytest.raises(SchemaError) as e:
            Schema(fields)
        assert e.value.code == code
    s = Schema.of(a=INT32, b=(timestamp(TimeUnit.SECOND), True))
    assert Schema.from_spark(s.to_spark()) == s


A7L, A7R = Schema.of(id=INT32, key=(INT32, True)), Schema.of(rightKey=(INT32, True), label=(UTF8, True))
L7, R7 = [(1, 1), (2, None), (3, 1), (4, 2)], [(1, "x"), (1, "y"), (None, None), (3, "z")]


def test_joins(run):
    on = lambda a, b: a["key"].eq(b["rightKey"])
    assert sorted(r[0] for r in run(lambda a, b: a.inner_join(b, on), (A7L, L7), (A7R, R7))) == [1, 1, 3, 3]
    left = run(lambda a, b: a.left_join(b, on), (A7L, L7), (A7R, R7))
    assert sorted((r[0], r[3] or "") for r in left) == [(1, "x"), (1, "y"), (2, ""), (3, "x"), (3, "y"), (4, "")]
    right = run(lambda a, b: a.right_join(b, on), (A7L, L7), (A7R, R7))
    assert sorted((r[0] or 0, r[3] or "") for r in right) == [(0, ""), (0, "z"), (1, "x"), (1, "y"), (3, "x"), (3, "y")]
    assert sorted(r[0] for r in run(lambda a, b: a.semi_join(b, on), (A7L, L7), (A7R, R7))) == [1, 3]
    assert sorted(r[0] for r in run(lambda a, b: a.anti_join(b, on), (A7L, L7), (A7R, R7))) == [2, 4]
    theta = lambda a, b: a["id"] > b["threshold"]
    t = Schema.of(threshold=INT32)
    ids = Schema.of(id=INT32)
    assert run(lambda a, b: a.semi_join(b, theta), (ids, [(1,), (3,)]), (t, [])) == []
    assert sorted(run(lambda a, b: a.anti_join(b, theta), (ids, [(1,), (3,)]), (t, []))) == [(1,), (3,)]
    assert run(lambda a, b: a.semi_join(b, theta), (ids, [(1,), (3,)]), (t, [(2,), (0,)])) == [(1,), (3,)]


def test_using_joins(run):
    a, b = Schema.of(key=(INT32, True), leftLabel=(UTF8, True)), Schema.of(key=(INT32, True), rightLabel=(UTF8, True))
    left, right = [(1, "a"), (None, None), (2, "b")], [(1, "x"), (1, "y"), (None, None)]
    assert sorted(run(lambda p, q: p.inner_join_using(q, "key"), (a, left), (b, right))) == [(1, "a", "x"), (1, "a", "y")]
    assert sorted((r[2] or "") for r in run(lambda p, q: p.left_join_using(q, "key"), (a, left), (b, right))) == ["", "", "x", "y"]
    p, q = Schema.of(group=INT32, id=INT32, leftLabel=UTF8), Schema.of(id=INT32, group=INT32, rightLabel=UTF8)
    rows = run(lambda x, y: x.inner_join_using(y, "group", "id"), (p, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (9, 9, "d")]), (q, [(1, 1, "x"), (2, 1, "y"), (1, 2, "z")]))
    assert sorted(r[3] for r in rows) == ["x", "y", "z"]
    f, g = Frame.source("f", p), Frame.source("g", q)
    fails("EmptyJoinKeys", lambda: f.inner_join_using(g))
    fails("DuplicateJoinKey", lambda: f.inner_join_using(g, "id", "id"))
    fails("ColumnNotFound", lambda: f.inner_join_using(g, "leftLabel"))
    fails("JoinKeyType", lambda: f.inner_join_using(Frame.source("h", Schema.of(id=INT64)), "id"))
    fails("ColumnCollision", lambda: f.inner_join_using(g, "id"))
    fails("ColumnCollision", lambda: f.inner_join(g, lambda a_, b_: literal(True)))


def test_self_join_and_nan_keys(run):
    s = Schema.of(a=FLOAT64, n=INT32)
    rows = [(NAN, 1), (1.0, 2), (0.0, 3), (-0.0, 4)]

    def build(f):
        return f.inner_join(f.rename_all(("a", "b"), ("n", "m")), lambda x, y: x["a"].eq(y["b"]))

    assert sorted((r[1], r[3]) for r in run(build, (s, rows))) == [(2, 2), (3, 3), (3, 4), (4, 3), (4, 4)]
    assert len(run(lambda f: f.semi_join(f, lambda x, y: x["n"] < y["n"]), (s, rows))) == 3


def test_groups(run):
    s = Schema.of(group=(UTF8, True), amount=(FLOAT64, True), item=INT32)
    rows = [("a", 1.0, 1), (None, 5.0, 2), ("a", None, 3), (None, 7.0, 4), ("a", 3.0, 5)]
    got = run(lambda f: f.group_by("group").aggregate(count().as_("n"), lambda r: [sum_(r["amount"]).as_("s"), mean(r["amount"]).as_("m"), variance_pop(r["amount"]).as_("v"), stddev_pop(r["amount"]).as_("d"), min_(r["item"]).as_("lo"), max_(r["item"]).as_("hi")]), (s, rows))
    assert sorted(got, key=repr) == sorted([("a", 3, 4.0, 2.0, 1.0, 1.0, 1, 5), (None, 2, 12.0, 6.0, 1.0, 1.0, 2, 4)], key=repr)
    e = Schema.of(value=(FLOAT64, True))
    assert run(lambda f: f.group_by().aggregate(count().as_("n"), lambda r: sum_(r["value"]).as_("s"), lambda r: mean(r["value"]).as_("m")), (e, [])) == [(0, None, None)]
    assert run(lambda f: f.group_by("value").aggregate(count().as_("n")), (e, [])) == []
    v = Schema.of(group=UTF8, value=FLOAT64)
    lows = run(lambda f: f.group_by("group").aggregate(lambda r: min_(r["value"]).as_("lo"), lambda r: max_(r["value"]).as_("hi")), (v, [("first", NAN), ("first", 1.0), ("last", 1.0), ("last", NAN)]))
    assert all(math.isnan(x) and math.isnan(y) for _, x, y in lows)
    assert sorted(run(lambda f: f.group_by("group").aggregate(), (v, [("a", 1.0), ("a", 2.0), ("b", 1.0)]))) == [("a",), ("b",)]
    w = Schema.of(i=INT32, f=FLOAT32)
    assert run(lambda f: f.group_by().aggregate(lambda r: sum_(r["i"]).as_("i"), lambda r: sum_(r["f"]).as_("f")), (w, [(1, 0.5), (2, 0.25)])) == [(3, 0.75)]
    with pytest.raises(ExecutionError) as err:
        run(lambda f: f.group_by().aggregate(lambda r: sum_(r["i"]).as_("i")), (w, [(2**31 - 1, 0.0), (1, 0.0)]))
    assert err.value.code == "IntegerOverflow"
    fails("DuplicateOutputNames", lambda: Frame.source("x", v).group_by("group").aggregate(count().as_("group")))


def test_distinct_and_zero_columns(run):
    s = Schema.of(value=FLOAT64, optional=(INT32, True), text=UTF8, at=TIMESTAMP)
    t = datetime.datetime(2024, 1, 1)
    rows = [(NAN, None, "a", t), (-NAN, None, "a", t), (0.0, 1, "b", t), (-0.0, 1, "b", t), (1.0, 1, "b", t), (1.0, 1, "b", t)]
    assert len(run(lambda f: f.distinct(), (s, rows))) == 3
    one = Schema.of(id=INT32)
    assert run(lambda f: f.drop("id"), (one, [(1,), (2,), (3,)])) == [(), (), ()]
    assert run(lambda f: f.drop("id").distinct(), (one, [(1,), (2,), (3,)])) == [()]
    assert run(lambda f: f.drop("id").distinct(), (one, [])) == [()]


def test_sorts(run):
    s = Schema.of(key=(INT32, True), label=UTF8)
    rows = [(2, "a"), (None, "b"), (1, "c"), (1, "d")]
    for order, nulls, want in [(Order.ASCENDING, Nulls.FIRST, "bcda"), (Order.ASCENDING, Nulls.LAST, "cdab"), (Order.DESCENDING, Nulls.FIRST, "bacd"), (Order.DESCENDING, Nulls.LAST, "acdb")]:
        assert "".join(r[1] for r in run(lambda f, o=order, n=nulls: f.sort_by("key", order=o, nulls=n), (s, rows))) == want
    m = Schema.of(major=(INT32, True), minor=(INT32, True), label=UTF8)
    got = run(lambda f: f.sort_by(lambda r: r["major"].asc(Nulls.LAST), lambda r: r["minor"].desc(Nulls.FIRST)), (m, [(1, 1, "a"), (1, None, "b"), (1, 2, "c"), (2, 5, "d"), (None, 0, "e"), (1, 2, "f")]))
    assert "".join(r[2] for r in got) == "bcfade"
    z = Schema.of(x=FLOAT64, n=INT32)
    assert [r[1] for r in run(lambda f: f.sort_by("x"), (z, [(0.0, 1), (-0.0, 2), (NAN, 3), (-1.0, 4), (INF, 5)]), strict_zero=True)] == [4, 2, 1, 5, 3]


def test_union_limit_and_literals(run):
    s = Schema.of(id=INT32)
    assert run(lambda a, b: a.union_all(b), (s, [(1,), (1,)]), (s, [(2,), (1,)])) == [(1,), (1,), (2,), (1,)]
    f = Frame.source("l", Schema.of(id=INT32, value=(FLOAT64, True)))
    with pytest.raises(FrameError) as e:
        f.union_all(Frame.source("r", Schema.of(key=INT64, value=FLOAT64)))
    assert [(i.kind, i.index) for i in e.value.details["issues"]] == [("FieldName", 0), ("FieldType", 0), ("FieldNullability", 1)]
    assert run(lambda a: a.limit(2), (s, [(1,), (2,), (3,)])) == [(1,), (2,)]
    assert run(lambda a: a.limit(0), (s, [(1,)])) == []
    t = datetime.datetime(2020, 5, 6, 7, 8, 9, 123456)
    got = run(lambda a: a.select(lambda r: literal(t).as_("t"), lambda r: null_literal(UTF8).as_("n"), lambda r: literal("é`x").as_("s"), lambda r: literal(0, TIMESTAMP).as_("z")), (s, [(1,)]))
    assert got == [(t, None, "é`x", datetime.datetime(1970, 1, 1))]


def test_odd_names_and_required(run):
    s = Schema([Field("a.b", INT32), Field("A", UTF8), Field("a", UTF8), Field("x`y", INT32)])
    assert run(lambda f: f.select("x`y", "a.b", "a", "A"), (s, [(1, "U", "l", 2)])) == [(2, 1, "l", "U")]
    with pytest.raises(StorageError):
        run(lambda f: f, (Schema.of(id=INT32), [(None,)]))
