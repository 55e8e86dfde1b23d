"""Random rows through Spark and through the row oracle."""

import math
import random

import pytest

from plumbframe import BOOL, FLOAT64, INT32, INT64, UTF8, Frame, FrameRuntime, Nulls, Order, Schema, SourceRef, count, literal, max_, mean, min_, rows_binding, stddev_pop, sum_, variance_pop
from tests.row_oracle import canonical, execute

LEFT = Schema.of(id=INT32, key=(INT32, True), name=(UTF8, True), value=(FLOAT64, True), flag=(BOOL, True), big=INT64)
RIGHT = Schema.of(rid=INT32, rkey=(INT32, True), rname=(UTF8, True), rvalue=(FLOAT64, True))
FLOATS = [0.0, -0.0, 1.0, -1.5, 2.25, math.nan, math.inf, -math.inf, 1e300, -1e-300]
TEXTS = ["", "a", "A", "é", "z", "null", '"', "a,b", "\n", "🙂"]


def rows(rnd, n):
    some = lambda f: None if rnd.random() < 0.3 else f()
    return [(i, some(lambda: rnd.randint(0, 5)), some(lambda: rnd.choice(TEXTS)), some(lambda: rnd.choice(FLOATS)), some(lambda: rnd.random() < 0.5), rnd.randint(-100, 100)) for i in range(n)]


FRAMES = {
    "arithmetic": lambda a, b: a.select("id", lambda r: (r["value"] + 1.0).as_("p"), lambda r: (r["value"] * r["value"]).as_("m"), lambda r: (r["value"] / literal(0.0)).as_("d"), lambda r: (literal(1.0) / r["value"]).as_("i"), lambda r: (-r["value"]).as_("n"), lambda r: r["value"].sqrt().as_("s"), lambda r: (r["big"] * 3 - r["big"] / 7).as_("b")),
    "comparisons": lambda a, b: a.inner_join(b, lambda x, y: x["key"].eq(y["rkey"])).select("id", "rid", *[lambda r, f=f, n=n: f(r["value"], r["rvalue"]).as_(n) for n, f in {"eq": lambda x, y: x.eq(y), "ne": lambda x, y: x.ne(y), "ns": lambda x, y: x.null_safe_eq(y), "lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y}.items()]),
    "texts": lambda a, b: a.select("id", lambda r: (r["name"] < "b").as_("lt"), lambda r: r["name"].eq("a").as_("eq"), lambda r: r["name"].null_safe_eq("").as_("ns"), lambda r: (r["flag"] & (r["name"] >= "a")).as_("and"), lambda r: (r["flag"] | r["name"].is_null()).as_("or")),
    "filters": lambda a, b: a.filter(lambda r: (r["value"] > 0.5).is_true() | r["flag"].is_false()).filter(lambda r: r["value"].eq(r["value"]).is_true() | r["key"].is_null()),
    "inner": lambda a, b: a.inner_join(b, lambda x, y: x["key"].eq(y["rkey"]) & (x["value"] < y["rvalue"])),
    "left": lambda a, b: a.left_join(b, lambda x, y: x["value"].eq(y["rvalue"])),
    "right": lambda a, b: a.right_join(b, lambda x, y: x["key"].eq(y["rkey"])),
    "semi": lambda a, b: a.semi_join(b, lambda x, y: x["value"].eq(y["rvalue"])),
    "anti": lambda a, b: a.anti_join(b, lambda x, y: x["name"].eq(y["rname"])),
    "theta": lambda a, b: a.inner_join(b, lambda x, y: (x["value"] >= y["rvalue"]) | x["key"].null_safe_eq(y["rkey"])),
    "self": lambda a, b: a.inner_join_using(a.rename_all(("id", "id2"), ("name", "n2"), ("value", "v2"), ("flag", "f2"), ("big", "b2")), "key"),
    "groups": lambda a, b: a.group_by("key", "name").aggregate(count().as_("n"), lambda r: [sum_(r["big"]).as_("s"), min_(r["value"]).as_("lo"), max_(r["value"]).as_("hi"), min_(r["flag"]).as_("f"), max_(r["name"]).as_("t")]),
    "float keys": lambda a, b: a.filter(lambda r: r["value"].ne(0.0).is_true() | r["value"].is_null()).group_by("value").aggregate(count().as_("n")),
    "distinct": lambda a, b: a.select("key", "name", "flag").distinct(),
    "union": lambda a, b: a.select("id", "key").union_all(b.rename_all(("rid", "id"), ("rkey", "key")).select("id", "key")).filter(lambda r: (r["key"] > literal(1, INT32)).is_true()),
    "sorted": lambda a, b: a.sort_by(lambda r: r["value"].desc(Nulls.FIRST), lambda r: r["key"].asc(Nulls.LAST)).limit(7),
    "sorted stably": lambda a, b: a.sort_by("flag", order=Order.DESCENDING, nulls=Nulls.LAST),
}


@pytest.mark.parametrize("name", FRAMES)
@pytest.mark.parametrize("seed", [1, 2])
def test_as_the_row_oracle(spark, name, seed):
    rnd = random.Random(seed)
    left, right = rows(rnd, 40), [r[:4] for r in rows(rnd, 30)]
    bindings = [rows_binding(left, LEFT, SourceRef.values("l")), rows_binding(right, RIGHT, SourceRef.values("r"))]
    frame = FRAMES[name](*[b.frame for b in bindings])
    got = FrameRuntime(spark, *bindings, strict_zero=True).collect(frame)
    want = execute(frame.plan, {"l": left, "r": right})
    assert got.schema == frame.schema
    assert canonical(got.rows()) == canonical(want)
    if name.startswith("sorted"):
        assert [canonical([r]) for r in got.rows()] == [canonical([r]) for r in want]


def test_statistics(spark):
    rnd = random.Random(5)
    data = [(f"g{rnd.randint(0, 3)}", None if rnd.random() < 0.2 else rnd.uniform(-9, 9)) for _ in range(200)]
    b = rows_binding(data, Schema.of(g=UTF8, x=(FLOAT64, True)), SourceRef.values("l"))
    frame = b.frame.group_by("g").aggregate(lambda r: [sum_(r["x"]).as_("s"), mean(r["x"]).as_("m"), variance_pop(r["x"]).as_("v"), stddev_pop(r["x"]).as_("d")])
    assert canonical(FrameRuntime(spark, b).collect(frame).rows(), 9) == canonical(execute(frame.plan, {"l": data}), 9)


def test_every_frame_explains():
    f, g = Frame.source("l", LEFT), Frame.source("r", RIGHT)
    for build in FRAMES.values():
        text = build(f, g).explain()
        assert "1e300" not in text and "  Scan[" in text
