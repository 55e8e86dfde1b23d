"""Queries over the test tables, one or more for each operator of the algebra, each with the SQL that says the same.

Sums of fractions depend on the order of addition, so such results are rounded on both sides; the frames themselves don't round.
"""

from __future__ import annotations

import atexit
import contextlib
import dataclasses
import datetime
import functools
import io
import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbframe.errors import PlumbError
from plumbframe.functions import Nulls, Order, count, literal, max_, mean, min_, stddev_pop, sum_, variance_pop
from plumbframe.operators import Frame, Row
from plumbframe.plans.nodes import SourceRef
from plumbframe.plans.requests import ScanRequest, scan_requests
from plumbframe.runtime import EnginePolicy, FrameRuntime
from plumbframe.sources import ArrowSink, NullPolicy, ScanPlan, SourceBinding, arrow_bytes, arrow_ipc_binding, csv_options, dataframe_binding, delimited_binding, delimited_path_binding, header_names, header_names_of_path, parquet_binding, rows_binding, source_binding, table_binding, to_text, tsv_options, write_text
from plumbframe.table import Table
from plumbframe.types import BOOL, FLOAT32, FLOAT64, INT32, INT64, TIMESTAMP, UTF8, DataType, Field, Schema

# The schemas of the tables.
TABLES = {
    "region": Schema.of(r_regionkey=INT32, r_name=UTF8),
    "nation": Schema.of(n_nationkey=INT32, n_name=UTF8, n_regionkey=INT32),
    "customer": Schema.of(c_custkey=INT64, c_name=UTF8, c_nationkey=INT32, c_acctbal=FLOAT64, c_mktsegment=UTF8),
    "supplier": Schema.of(s_suppkey=INT64, s_name=UTF8, s_nationkey=INT32, s_acctbal=FLOAT64),
    "part": Schema.of(p_partkey=INT64, p_name=UTF8, p_brand=UTF8, p_type=UTF8, p_size=INT32, p_retailprice=FLOAT64),
    "orders": Schema.of(o_orderkey=INT64, o_custkey=INT64, o_orderstatus=UTF8, o_totalprice=FLOAT64, o_orderdate=TIMESTAMP, o_orderpriority=UTF8),
    "lineitem": Schema.of(l_orderkey=INT64, l_partkey=INT64, l_suppkey=INT64, l_linenumber=INT32, l_quantity=FLOAT64, l_extendedprice=FLOAT64, l_discount=FLOAT64, l_tax=FLOAT64, l_returnflag=UTF8, l_linestatus=UTF8, l_shipdate=TIMESTAMP),
    "events": Schema.of(event_id=INT64, ts=TIMESTAMP, user_id=INT64, event_type=UTF8, value=FLOAT64, props=UTF8),
}

T: dict[str, Frame] = {name: Frame.source(name, schema) for name, schema in TABLES.items()}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


@functools.lru_cache(maxsize=8)
def runtime(spark: SparkSession, sf_dir: str) -> FrameRuntime:
    return FrameRuntime(spark, *(parquet_binding(f"{sf_dir}/{n}.parquet", s, SourceRef.scan(n)) for n, s in TABLES.items()))


def _add(name: str, frame: Frame, sql: str, **digits: int) -> None:
    """digits: of each column that is rounded, how far; the SQL has it rounded too."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = runtime(spark, sf_dir).dataframe(frame)
        return df.withColumns({c: F.round(c, n) for c, n in digits.items()}) if digits else df

    QUERIES[name], ORACLES[name] = run, sql


def _own(name: str, run: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


def _i32(n: int):
    return literal(n, INT32)


ORDERS, LINES, PART, CUSTOMER, SUPPLIER, NATION, REGION, EVENTS = (T[n] for n in ("orders", "lineitem", "part", "customer", "supplier", "nation", "region", "events"))
DAY = datetime.datetime(1998, 9, 2)
KEYS = LINES.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")

# Scans and projections

_add("scan_orders", ORDERS, "SELECT * FROM orders")
_add("select_exprs", LINES.select("l_orderkey", "l_linenumber", lambda r: (r["l_extendedprice"] * (literal(1.0) - r["l_discount"])).as_("net"), lambda r: (r["l_quantity"] + 1.0).as_("more")), "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS net, l_quantity + 1.0::DOUBLE AS more FROM lineitem")
_add("with_column", PART.with_column("twice", lambda r: r["p_size"] * _i32(2)), "SELECT *, (p_size * 2)::INTEGER AS twice FROM part")
_add("rename_one", REGION.rename("r_name", "name"), "SELECT r_regionkey, r_name AS name FROM region")
_add("rename_all_swap", NATION.rename_all(("n_nationkey", "n_regionkey"), ("n_regionkey", "n_nationkey")), "SELECT n_nationkey AS n_regionkey, n_name, n_regionkey AS n_nationkey FROM nation")
_add("drop_one", NATION.drop("n_regionkey"), "SELECT n_nationkey, n_name FROM nation")
_add("drop_all", ORDERS.drop_all("o_orderpriority", "o_orderstatus"), "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
_add("replace_type", SUPPLIER.replace("s_acctbal", lambda r: r["s_acctbal"] > 0.0), "SELECT s_suppkey, s_name, s_nationkey, s_acctbal > 0 AS s_acctbal FROM supplier")
_add("replace_all", PART.replace_all({"p_size": lambda r: r["p_size"] + _i32(1), "p_retailprice": lambda r: r["p_retailprice"] * 2.0}), "SELECT p_partkey, p_name, p_brand, p_type, (p_size + 1)::INTEGER AS p_size, p_retailprice * 2.0::DOUBLE AS p_retailprice FROM part")

# Filters

for _name, _op, _f in (("eq", "=", lambda r: r["p_size"].eq(_i32(15))), ("ne", "<>", lambda r: r["p_size"].ne(_i32(15))), ("lt", "<", lambda r: r["p_size"] < _i32(15)), ("le", "<=", lambda r: r["p_size"] <= _i32(15)), ("gt", ">", lambda r: r["p_size"] > _i32(15)), ("ge", ">=", lambda r: r["p_size"] >= _i32(15))):
    _add(f"filter_cmp_{_name}", PART.filter(_f), f"SELECT * FROM part WHERE p_size {_op} 15")
_add("filter_and_or", LINES.filter(lambda r: (r["l_quantity"] < 10.0) & (r["l_returnflag"].eq("R") | r["l_returnflag"].eq("A"))), "SELECT * FROM lineitem WHERE l_quantity < 10 AND (l_returnflag = 'R' OR l_returnflag = 'A')")
_add("filter_utf8_order", CUSTOMER.filter(lambda r: r["c_mktsegment"] >= "F"), "SELECT * FROM customer WHERE c_mktsegment >= 'F'")
_add("filter_timestamp", ORDERS.filter(lambda r: r["o_orderdate"] < datetime.datetime(1995, 3, 15)), "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-15'")

# Scalar expressions

_add("arith_int_checked", PART.select("p_partkey", lambda r: (r["p_size"] * _i32(3) - _i32(7)).as_("a"), lambda r: (r["p_partkey"] * 5 + 1).as_("b")), "SELECT p_partkey, (p_size * 3 - 7)::INTEGER AS a, (p_partkey * 5 + 1)::BIGINT AS b FROM part")
_add("int_div_trunc", PART.select("p_partkey", lambda r: ((r["p_size"] - _i32(25)) / _i32(7)).as_("q"), lambda r: (r["p_partkey"] / 3).as_("w")), "SELECT p_partkey, ((p_size - 25) // 7)::INTEGER AS q, (p_partkey // 3)::BIGINT AS w FROM part")
_add("float_div", KEYS.select("l_orderkey", "l_linenumber", lambda r: (r["l_extendedprice"] / r["l_quantity"]).as_("unit")), "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem")
_add("float_div_zero_ieee", KEYS.select("l_orderkey", "l_linenumber", lambda r: ((r["l_tax"] / r["l_discount"]) > 1e300).as_("infinite"), lambda r: (r["l_tax"] / r["l_discount"]).ne(r["l_tax"] / r["l_discount"]).as_("not_a_number")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN true ELSE l_tax / l_discount > 1e300 END AS infinite, l_discount = 0 AND l_tax = 0 AS not_a_number FROM lineitem")
_add("negate", SUPPLIER.select("s_suppkey", lambda r: (-r["s_acctbal"]).as_("owed"), lambda r: (-r["s_nationkey"]).as_("n")), "SELECT s_suppkey, -s_acctbal AS owed, (-s_nationkey)::INTEGER AS n FROM supplier")
_add("sqrt_double", KEYS.select("l_orderkey", "l_linenumber", lambda r: r["l_quantity"].sqrt().as_("root"), lambda r: (-r["l_quantity"]).sqrt().eq((-r["l_quantity"]).sqrt()).as_("real")), "SELECT l_orderkey, l_linenumber, sqrt(l_quantity) AS root, false AS real FROM lineitem")
_add("compare_all", PART.select("p_partkey", lambda r: (r["p_size"] < _i32(20)).as_("lt"), lambda r: (r["p_size"] <= _i32(20)).as_("le"), lambda r: (r["p_size"] > _i32(20)).as_("gt"), lambda r: (r["p_size"] >= _i32(20)).as_("ge"), lambda r: r["p_size"].eq(_i32(20)).as_("eq"), lambda r: r["p_size"].ne(_i32(20)).as_("ne")), "SELECT p_partkey, p_size < 20 AS lt, p_size <= 20 AS le, p_size > 20 AS gt, p_size >= 20 AS ge, p_size = 20 AS eq, p_size <> 20 AS ne FROM part")

_LATE = ORDERS.filter(lambda r: r["o_totalprice"] > 200000.0).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
_LOOSE = CUSTOMER.select("c_custkey").left_join(_LATE, lambda c, o: c["c_custkey"].eq(o["o_custkey"]))
_LOOSE_SQL = "(SELECT c_custkey, o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey)"
_add("is_null_after_left_join", _LOOSE.select("c_custkey", "o_orderkey", lambda r: r["o_orderkey"].is_null().as_("missing"), lambda r: r["o_orderkey"].is_not_null().as_("there")), f"SELECT c_custkey, o_orderkey, o_orderkey IS NULL AS missing, o_orderkey IS NOT NULL AS there FROM {_LOOSE_SQL}")
_add("is_true_false", _LOOSE.select("c_custkey", "o_orderkey", lambda r: (r["o_totalprice"] > 250000.0).is_true().as_("t"), lambda r: (r["o_totalprice"] > 250000.0).is_false().as_("f")), f"SELECT c_custkey, o_orderkey, coalesce(o_totalprice > 250000, false) AS t, coalesce(NOT o_totalprice > 250000, false) AS f FROM {_LOOSE_SQL}")
_add("null_safe_eq", _LOOSE.select("c_custkey", "o_orderkey", lambda r: r["o_orderstatus"].null_safe_eq("F").as_("same"), lambda r: r["o_custkey"].null_safe_eq(r["o_orderkey"]).as_("both")), f"SELECT c_custkey, o_orderkey, o_orderstatus IS NOT DISTINCT FROM 'F' AS same, o_custkey IS NOT DISTINCT FROM o_orderkey AS both FROM {_LOOSE_SQL}")
_add("three_valued_logic", _LOOSE.select("c_custkey", "o_orderkey", lambda r: ((r["o_totalprice"] > 250000.0) & (r["c_custkey"] > 500)).as_("a"), lambda r: ((r["o_totalprice"] > 250000.0) | (r["c_custkey"] > 500)).as_("o")), f"SELECT c_custkey, o_orderkey, o_totalprice > 250000 AND c_custkey > 500 AS a, o_totalprice > 250000 OR c_custkey > 500 AS o FROM {_LOOSE_SQL}")
_add("filter_is_true", _LOOSE.filter(lambda r: (r["o_totalprice"] > 250000.0).is_true()), f"SELECT * FROM {_LOOSE_SQL} WHERE o_totalprice > 250000")
_add("filter_is_false", _LOOSE.filter(lambda r: (r["o_totalprice"] > 250000.0).is_false()), f"SELECT * FROM {_LOOSE_SQL} WHERE NOT o_totalprice > 250000")

# Joins

_add("inner_join_equi", ORDERS.inner_join(CUSTOMER, lambda o, c: o["o_custkey"].eq(c["c_custkey"])), "SELECT orders.*, customer.* FROM orders JOIN customer ON o_custkey = c_custkey")
_add("inner_join_using", NATION.rename("n_regionkey", "r_regionkey").inner_join_using(REGION, "r_regionkey"), "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_PAIRS = LINES.group_by("l_partkey", "l_suppkey").aggregate(lambda r: sum_(r["l_quantity"]).as_("all_quantity"))
_add("inner_join_multi_key_using", LINES.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").inner_join_using(_PAIRS, "l_partkey", "l_suppkey"), "SELECT l_orderkey, l_linenumber, l.l_partkey, l.l_suppkey, l_quantity, all_quantity FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, sum(l_quantity) AS all_quantity FROM lineitem GROUP BY 1, 2) p ON l.l_partkey = p.l_partkey AND l.l_suppkey = p.l_suppkey")
_add("left_join", _LOOSE, f"SELECT * FROM {_LOOSE_SQL}")
_add("left_join_using", CUSTOMER.select("c_custkey", "c_name").left_join_using(_LATE.rename("o_custkey", "c_custkey"), "c_custkey"), "SELECT c_custkey, c_name, o_orderkey, o_totalprice, o_orderstatus FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")
_add("right_join", _LATE.right_join(CUSTOMER.select("c_custkey"), lambda o, c: o["o_custkey"].eq(c["c_custkey"])), f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, c_custkey FROM {_LOOSE_SQL}")
_add("semi_join", CUSTOMER.semi_join(_LATE, lambda c, o: c["c_custkey"].eq(o["o_custkey"])), "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
_add("anti_join", CUSTOMER.anti_join(_LATE, lambda c, o: c["c_custkey"].eq(o["o_custkey"])), "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
_add("theta_join_range", NATION.inner_join(REGION, lambda n, r: (n["n_regionkey"] > r["r_regionkey"]) & (n["n_nationkey"] < _i32(20))), "SELECT nation.*, region.* FROM nation JOIN region ON n_regionkey > r_regionkey AND n_nationkey < 20")
_add("semi_join_theta", NATION.semi_join(REGION, lambda n, r: n["n_nationkey"] < r["r_regionkey"]), "SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE n_nationkey < r_regionkey)")
_add("anti_join_theta", NATION.anti_join(REGION, lambda n, r: n["n_nationkey"] < r["r_regionkey"]), "SELECT * FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE n_nationkey < r_regionkey)")
_add("self_join", NATION.inner_join(NATION.rename_all(("n_nationkey", "k2"), ("n_name", "name2"), ("n_regionkey", "r2")), lambda a, b: a["n_regionkey"].eq(b["r2"]) & (a["n_nationkey"] < b["k2"])), "SELECT a.*, b.n_nationkey AS k2, b.n_name AS name2, b.n_regionkey AS r2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("cross_join_literal", REGION.inner_join(REGION.rename_all(("r_regionkey", "k2"), ("r_name", "name2")), lambda a, b: literal(True)), "SELECT a.*, b.r_regionkey AS k2, b.r_name AS name2 FROM region a, region b")

# Groups

_add("agg_count_sum_mean", LINES.group_by("l_returnflag", "l_linestatus").aggregate(count().as_("n"), lambda r: sum_(r["l_quantity"]).as_("quantity"), lambda r: mean(r["l_quantity"]).as_("mean_quantity")), "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, avg(l_quantity) AS mean_quantity FROM lineitem GROUP BY 1, 2")
_add("agg_var_std_pop", LINES.group_by("l_returnflag").aggregate(lambda r: variance_pop(r["l_quantity"]).as_("v"), lambda r: stddev_pop(r["l_quantity"]).as_("s")), "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS v, round(stddev_pop(l_quantity), 6) AS s FROM lineitem GROUP BY 1", v=6, s=6)
_add("agg_min_max_all_types", ORDERS.group_by("o_orderstatus").aggregate(*[lambda r, c=c, f=f, n=n: f(r[c]).as_(f"{n}_{c}") for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority") for f, n in ((min_, "min"), (max_, "max"))]), "SELECT o_orderstatus, " + ", ".join(f"{n}({c}) AS {n}_{c}" for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority") for n in ("min", "max")) + " FROM orders GROUP BY 1")
_add("agg_global", LINES.group_by().aggregate(count().as_("n"), lambda r: sum_(r["l_quantity"]).as_("q"), lambda r: min_(r["l_shipdate"]).as_("first")), "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_shipdate) AS first FROM lineitem")
_add("agg_global_empty", LINES.filter(lambda r: r["l_quantity"] < -1.0).group_by().aggregate(count().as_("n"), lambda r: sum_(r["l_quantity"]).as_("q"), lambda r: mean(r["l_quantity"]).as_("m"), lambda r: min_(r["l_returnflag"]).as_("f")), "SELECT count(*) AS n, sum(l_quantity) AS q, avg(l_quantity) AS m, min(l_returnflag) AS f FROM lineitem WHERE l_quantity < -1")
_add("agg_expr_keys", PART.group_by(lambda r: (r["p_size"] / _i32(10)).as_("decade")).aggregate(count().as_("n"), lambda r: max_(r["p_size"]).as_("largest")), "SELECT (p_size // 10)::INTEGER AS decade, count(*) AS n, max(p_size) AS largest FROM part GROUP BY 1")
_add("group_null_key", _LOOSE.group_by("o_orderstatus").aggregate(count().as_("n"), lambda r: min_(r["o_totalprice"]).as_("least")), f"SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS least FROM {_LOOSE_SQL} GROUP BY 1")
_add("sum_int_width", PART.group_by("p_brand").aggregate(lambda r: sum_(r["p_size"]).as_("sizes"), lambda r: sum_(r["p_partkey"]).as_("keys")), "SELECT p_brand, sum(p_size)::INTEGER AS sizes, sum(p_partkey)::BIGINT AS keys FROM part GROUP BY 1")
_add("distinct_multi", LINES.select("l_returnflag", "l_linestatus").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_add("distinct_all", REGION.union_all(REGION).distinct(), "SELECT DISTINCT * FROM region")
_add("group_key_only", CUSTOMER.group_by("c_mktsegment", "c_nationkey").aggregate(), "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")

# Sets, sorts and limits

_BOTH = CUSTOMER.select(lambda r: r["c_name"].as_("name"), lambda r: r["c_nationkey"].as_("nation")).union_all(SUPPLIER.select(lambda r: r["s_name"].as_("name"), lambda r: r["s_nationkey"].as_("nation")))
_BOTH_SQL = "(SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier)"
_add("union_all", _BOTH, f"SELECT * FROM {_BOTH_SQL}")
_add("union_distinct", _BOTH.select("nation").distinct(), f"SELECT DISTINCT nation FROM {_BOTH_SQL}")
_add("sort_limit_topk", ORDERS.sort_by(lambda r: r["o_totalprice"].desc(), "o_orderkey").limit(25), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_add("sort_multi_nulls", _LOOSE.sort_by(lambda r: r["o_totalprice"].asc(), "c_custkey", lambda r: r["o_orderkey"].asc()), f"SELECT * FROM {_LOOSE_SQL}")
for _order, _nulls in itertools.product(Order, Nulls):
    # A report of the first 40, so that the rows tell where nulls go.
    _add(f"topk_{_order.value.lower()}_nulls_{_nulls.value.lower()}", _LOOSE.sort_by(lambda r, o=_order, n=_nulls: r["o_totalprice"].asc(n) if o is Order.ASCENDING else r["o_totalprice"].desc(n), "c_custkey", lambda r: r["o_orderkey"].asc()).limit(40), f"SELECT * FROM {_LOOSE_SQL} ORDER BY o_totalprice {'ASC' if _order is Order.ASCENDING else 'DESC'} NULLS {_nulls.value.upper()}, c_custkey, o_orderkey NULLS LAST LIMIT 40")
_add("sort_shared_policy", _LOOSE.sort_by("o_orderstatus", "c_custkey", "o_orderkey", order=Order.DESCENDING, nulls=Nulls.FIRST).limit(40), f"SELECT * FROM {_LOOSE_SQL} ORDER BY o_orderstatus DESC NULLS FIRST, c_custkey DESC, o_orderkey DESC NULLS FIRST LIMIT 40")
_add("sort_dynamic_key", CUSTOMER.sort_by(CUSTOMER.schema.names[0]).limit(10), "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
_add("limit_of_limit", ORDERS.sort_by("o_orderkey").limit(30).limit(7), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 7")
_add("typed_dynamic_normalized", REGION.dynamic().typed(TABLES["region"]).normalized(), "SELECT * FROM region")
_add("limit_zero", ORDERS.limit(0), "SELECT * FROM orders LIMIT 0")

# Whole pipelines

_NET = lambda r: r["l_extendedprice"] * (literal(1.0) - r["l_discount"])


def _q1(r: Row) -> list:
    return [sum_(r["l_quantity"]).as_("sum_qty"), sum_(r["l_extendedprice"]).as_("sum_base_price"), sum_(r["disc_price"]).as_("sum_disc_price"), mean(r["l_quantity"]).as_("avg_qty"), mean(r["l_discount"]).as_("avg_disc"), min_(r["l_shipdate"]).as_("first_ship"), max_(r["l_shipdate"]).as_("last_ship"), count().as_("count_order")]


_add("pipeline_q1", LINES.filter(lambda r: r["l_shipdate"] <= DAY).with_column("disc_price", _NET).group_by("l_returnflag", "l_linestatus").aggregate(_q1).sort_by("l_returnflag", "l_linestatus"), "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1.0::DOUBLE - l_discount)), 2) AS sum_disc_price, avg(l_quantity) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", sum_base_price=2, sum_disc_price=2, avg_disc=6)
_q3 = CUSTOMER.filter(lambda r: r["c_mktsegment"].eq("BUILDING")).select("c_custkey").inner_join(ORDERS, lambda c, o: c["c_custkey"].eq(o["o_custkey"])).inner_join(LINES, lambda o, li: o["o_orderkey"].eq(li["l_orderkey"]))
_add("pipeline_q3_like", _q3.with_column("net", _NET).group_by("l_orderkey", "o_orderdate").aggregate(lambda r: sum_(r["net"]).as_("revenue")), "SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1.0::DOUBLE - l_discount)), 5) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2", revenue=5)
_add("pipeline_q6_like", LINES.filter(lambda r: (r["l_discount"] >= 0.05) & (r["l_discount"] <= 0.07) & (r["l_quantity"] < 24.0)).with_column("gain", lambda r: r["l_extendedprice"] * r["l_discount"]).group_by().aggregate(lambda r: sum_(r["gain"]).as_("revenue"), count().as_("n")), "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_discount >= 0.05::DOUBLE AND l_discount <= 0.07::DOUBLE AND l_quantity < 24", revenue=2)
_add("events_by_type", EVENTS.group_by("event_type").aggregate(count().as_("n"), lambda r: mean(r["value"]).as_("m"), lambda r: max_(r["ts"]).as_("last")), "SELECT event_type, count(*) AS n, round(avg(value), 6) AS m, max(ts) AS last FROM events GROUP BY 1", m=6)
_add("join_group_mean", SUPPLIER.inner_join(NATION, lambda s, n: s["s_nationkey"].eq(n["n_nationkey"])).group_by("n_name").aggregate(count().as_("n"), lambda r: mean(r["s_acctbal"]).as_("m")), "SELECT n_name, count(*) AS n, round(avg(s_acctbal), 6) AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", m=6)


# Sources and sinks: what is written and read again is the table that went in.


def _again(binding: SourceBinding, spark: SparkSession) -> DataFrame:
    return FrameRuntime(spark, binding).dataframe(binding.frame)


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted at the end of the program. Without such a folder a local one, if master is local; else an error."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='plumbframe-')}"
    path = f"{base.rstrip('/')}/plumbframe-io/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a folder left behind costs space, not results
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through the quote-aware parser, one file a task."""
    path = _folder(spark, "csv")
    write_text(runtime(spark, sf_dir).dataframe(ORDERS), path, csv_options(TABLES["orders"], header=False))
    # Timestamps are whole microseconds in the text, and come back as such.
    read = Schema(Field(f.name, INT64 if f.dtype == TIMESTAMP else f.dtype) for f in TABLES["orders"])
    df = _again(delimited_path_binding(path, csv_options(read, header=False)), spark)
    return df.withColumn("o_orderdate", F.timestamp_micros("o_orderdate").cast("timestamp_ntz"))


def _tsv_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, receipt = to_text(runtime(spark, sf_dir).dataframe(NATION), tsv_options(TABLES["nation"]))
    assert header_names(text.replace("\t", ",")) == list(TABLES["nation"].names) and receipt.rows > 0
    return _again(delimited_binding(text, tsv_options(TABLES["nation"])), spark)


def _csv_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text and only the empty token: Spark's reader has the same rules, in many tasks a file."""
    schema = Schema.of(r_name=UTF8, n_name=(UTF8, True))
    pairs = NATION.inner_join(REGION, lambda n, r: n["n_regionkey"].eq(r["r_regionkey"])).select("r_name", "n_name")
    path, options = _folder(spark, "csv"), csv_options(schema, nulls=NullPolicy(frozenset({""}), ""))
    write_text(runtime(spark, sf_dir).dataframe(pairs), path, options)
    binding = delimited_path_binding(path, options)
    assert binding.route == "spark.read.csv"
    return _again(binding, spark)


def _arrow_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = runtime(spark, sf_dir).collect(SUPPLIER)
    return _again(arrow_ipc_binding(arrow_bytes(table), TABLES["supplier"]), spark)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = runtime(spark, sf_dir).collect(REGION)
    return _again(rows_binding(list(table.rows()), table.schema), spark)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a filtered scan, put together again."""
    frame = PART.filter(lambda r: r["p_size"] > _i32(30)).select("p_partkey", "p_size")
    rows = [r for t in runtime(spark, sf_dir).stream(frame, 256) for r in t.rows()]
    return _again(table_binding(Table.from_rows(rows, frame.schema)), spark)


def _report(spark: SparkSession, found: list[tuple], /, **columns: DataType) -> DataFrame:
    schema = Schema(Field(n, t, True) for n, t in columns.items())
    return _again(rows_binding(found, schema), spark)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema.of(k=INT32, v=(UTF8, True), x=FLOAT32)
    binding = rows_binding([(1, "a", 0.1), (2, None, -2.5), (2, "é", 1e10)], schema, SourceRef.values("made"))
    return FrameRuntime(spark, binding).dataframe(Frame.values(SourceRef.values("made"), schema))


def _values_of_a_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of what sources and references refuse."""
    region = TABLES["region"]
    tries = {"scan as values": lambda: Frame.values(SourceRef.scan("r"), region), "blank id": lambda: SourceRef.scan(" "), "no id": lambda: SourceRef(None, "r"), "blank name": lambda: SourceRef("r", ""), "no name": lambda: SourceRef("r", None), "no order": lambda: SourceRef("r", "r", order=None)}
    rows = []
    for what, make in tries.items():
        try:
            make()
            rows.append((what, "made"))
        except PlumbError as e:
            rows.append((what, e.code))
    return _report(spark, rows, what=UTF8, code=UTF8)


def _sum_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of Float32 stay Float32: here whole numbers, which any order of addition gives."""
    lines = runtime(spark, sf_dir).dataframe(LINES.select("l_returnflag", "l_quantity")).select("l_returnflag", F.col("l_quantity").cast("float").alias("q"))
    binding = dataframe_binding(lines, Schema.of(l_returnflag=(UTF8, True), q=(FLOAT32, True)))
    summed = binding.frame.group_by("l_returnflag").aggregate(lambda r: sum_(r["q"]).as_("q"))
    assert summed.schema.fields[1].dtype == FLOAT32
    return FrameRuntime(spark, binding).dataframe(summed)


def _dynamic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema found when the query runs."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    frame = Frame.scan(SourceRef.scan("found"), Schema.from_spark(df.schema))
    names = [n for n in frame.schema.names if n.endswith(("key", "size"))]
    return FrameRuntime(spark, dataframe_binding(df, ref=SourceRef.scan("found"))).dataframe(frame.select(*names))


def _union_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a union's stream the left side comes whole before the right."""
    both = REGION.select("r_name").sort_by("r_name").union_all(NATION.select(lambda r: r["n_name"].as_("r_name")).sort_by("r_name"))
    rows = [r for t in runtime(spark, sf_dir).stream(both, 4) for r in t.rows()]
    return _report(spark, [(i, *r) for i, r in enumerate(rows)], at=INT32, name=UTF8)


def _limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = [len(t) for t in runtime(spark, sf_dir).stream(ORDERS.limit(23), 10)]
    return _report(spark, list(enumerate(sizes)), batch=INT32, rows=INT32)


def _stream_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rt = runtime(spark, sf_dir)
    frames = {"filter": PART.filter(lambda r: r["p_size"] > _i32(30)), "limit": PART.limit(3), "union": REGION.union_all(REGION), "sort": PART.sort_by("p_size"), "distinct": REGION.distinct(), "join": NATION.semi_join(REGION, lambda n, r: n["n_regionkey"].eq(r["r_regionkey"])), "group": PART.group_by("p_size").aggregate(count().as_("n"))}
    return _report(spark, [(n, rt.stream_physical_explain(f).splitlines()[0].removeprefix("route: ")) for n, f in frames.items()], frame=UTF8, route=UTF8)


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan of a collected frame read and took over, and the same of a streamed one."""
    frame = PART.filter(lambda r: r["p_size"] > _i32(30)).select("p_partkey")
    rt = runtime(spark, sf_dir)
    parts, streamed = rt.stream_with_receipt(frame, 500)
    collected = rt.collect_with_receipt(frame)[1]
    assert sum(map(len, parts)) >= 0
    rows = [(kind, r.engine, r.policy.value, s.source, ",".join(s.columns_read), any("GreaterThan(p_size,30)" in a for a in s.accepted), ",".join(s.requested.columns)) for kind, r in (("collected", collected), ("streamed", streamed)) for s in r.sources]
    return _report(spark, rows, kind=UTF8, engine=UTF8, policy=UTF8, source=UTF8, columns=UTF8, pushed=BOOL, asked=UTF8)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for name, frame in {"limit": ORDERS.select("o_orderkey", "o_custkey").limit(5), "below": ORDERS.limit(5).select("o_orderkey"), "join": _q3.select("o_orderkey"), "group": LINES.group_by("l_returnflag").aggregate(lambda r: sum_(r["l_tax"]).as_("t"), count().as_("n")).select("t")}.items():
        found += [(name, source, r.limit, ",".join(r.columns)) for source, r in scan_requests(frame.plan).items()]
    return _report(spark, found, frame=UTF8, source=UTF8, limit=INT32, columns=UTF8)


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = REGION.filter(lambda r: r["r_regionkey"] > _i32(1)).select("r_name").limit(3).explain()
    return _report(spark, list(enumerate(text.splitlines())), place=INT32, line=UTF8)


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and its schema as text."""
    table = runtime(spark, sf_dir).collect(REGION.sort_by("r_regionkey"))
    return _report(spark, [(i, x) for i, x in enumerate([*table.show(max_rows=4).splitlines(), *table.show_schema().splitlines()])], at=INT32, line=UTF8)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by position, cells by name, columns and dataclass instances tell the same."""
    table = runtime(spark, sf_dir).collect(REGION)
    kind = dataclasses.make_dataclass("Region", [("r_regionkey", int), ("r_name", str)])
    own = [table.row_as(i, kind) for i in range(len(table))]
    rows = [(table.cell(i, "r_regionkey"), table.row(i)[1], table.column("r_name")[i], x.r_name) for i, x in enumerate(own)]
    again = Table.from_rows(own, table.schema)
    return _report(spark, [(*r, again.cell(i, 0)) for i, r in enumerate(rows)], k=INT32, by_row=UTF8, by_column=UTF8, by_class=UTF8, again=INT32)


class _Numbers:
    """A source of one's own: numbers with their squares, of which it makes only what is asked for."""

    def inspect(self, spark: SparkSession) -> Schema:
        return Schema.of(n=INT64, square=INT64, word=UTF8)

    def plan(self, spark: SparkSession, request: ScanRequest) -> ScanPlan:
        made = {"n": F.col("id"), "square": F.col("id") * F.col("id"), "word": F.concat(F.lit("w"), F.col("id").cast("string"))}
        columns = [c for c in made if c in request.columns]
        return ScanPlan(spark.range(100).select(*[made[c].alias(c) for c in columns]), tuple(columns), ("columns",))


def _own_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    binding = source_binding(spark, _Numbers())
    frame = binding.frame.filter(lambda r: r["square"] > 2500).select("n")
    table, receipt = FrameRuntime(spark, binding).collect_with_receipt(frame)
    assert receipt.sources[0].columns_read == ("n", "square") and receipt.sources[0].accepted == ("columns",)
    return _again(table_binding(table), spark)


def _own_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches into a sink, and what the sink has read again."""
    out = io.BytesIO()
    receipt = runtime(spark, sf_dir).write(NATION, ArrowSink(out), 10)
    assert receipt.batches == -(-receipt.rows // 10) and receipt.bytes == len(out.getvalue())
    return _again(arrow_ipc_binding(out.getvalue(), TABLES["nation"]), spark)


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = delimited_binding("a\n1\n", csv_options(Schema.of(a=INT32)), SourceRef.scan("text"))
    rows = []
    for policy in EnginePolicy:
        for name, binding in (("text", text), ("rows", rows_binding([(1,)], Schema.of(a=INT32), SourceRef.values("rows")))):
            try:
                rows.append((policy.value, name, str(FrameRuntime(spark, binding, policy=policy).collect(binding.frame).column("a")[0])))
            except PlumbError as e:
                rows.append((policy.value, name, e.code))
    return _report(spark, rows, policy=UTF8, source=UTF8, outcome=UTF8)


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names in the header of written files."""
    path = _folder(spark, "csv")
    write_text(runtime(spark, sf_dir).dataframe(CUSTOMER.rename("c_name", 'a "name", quoted\nand long')), path, csv_options(CUSTOMER.rename("c_name", 'a "name", quoted\nand long').schema))
    return _report(spark, list(enumerate(header_names_of_path(spark, path))), place=INT32, name=UTF8)


def _stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text whose cells go beyond lines, through the parser, one file a task."""
    schema = Schema.of(k=INT64, t=(UTF8, True))
    df = runtime(spark, sf_dir).dataframe(CUSTOMER).select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit('\r\n"x", '), "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.lit("")).alias("t"))
    path = _folder(spark, "csv")
    write_text(df, path, csv_options(schema))
    return _again(delimited_path_binding(path, csv_options(schema)), spark)


_own("values_frame", _values, "SELECT k::INTEGER AS k, v, x::FLOAT AS x FROM (VALUES (1, 'a', 0.1), (2, NULL, -2.5), (2, 'é', 1e10)) AS t(k, v, x)")
_own("source_checks", _values_of_a_scan, "SELECT * FROM (VALUES ('scan as values', 'NotValuesSource'), ('blank id', 'InvalidSourceId'), ('no id', 'NullSourceId'), ('blank name', 'InvalidSourceName'), ('no name', 'NullSourceName'), ('no order', 'NullSourceOrder')) AS t(what, code)")
_own("sum_float32", _sum_float32, "SELECT l_returnflag, sum(l_quantity)::FLOAT AS q FROM lineitem GROUP BY 1")
_own("dynamic_scan", _dynamic_scan, "SELECT p_partkey, p_size FROM part")
_own("stream_union_order", _union_stream, "SELECT (row_number() OVER (ORDER BY side, name) - 1)::INTEGER AS at, name FROM (SELECT 0 AS side, r_name AS name FROM region UNION ALL SELECT 1, n_name FROM nation)")
_own("stream_limit_budget", _limit_stream, "SELECT * FROM (VALUES (0::INTEGER, 10::INTEGER), (1, 10), (2, 3)) AS t(batch, rows)")
_own("stream_routes", _stream_routes, "SELECT * FROM (VALUES ('filter', 'incremental'), ('limit', 'incremental'), ('union', 'incremental'), ('sort', 'materialized first'), ('distinct', 'materialized first'), ('join', 'materialized first'), ('group', 'materialized first')) AS t(frame, route)")
_own("scan_receipts", _receipts, "SELECT kind, 'spark' AS engine, 'Auto' AS policy, 'part' AS source, 'p_partkey,p_size' AS columns, true AS pushed, 'p_partkey,p_size' AS asked FROM (VALUES ('collected'), ('streamed')) AS t(kind)")
_own("scan_requests", _requests, "SELECT * FROM (VALUES ('limit', 'orders', NULL::INTEGER, 'o_orderkey,o_custkey'), ('below', 'orders', 5, 'o_orderkey'), ('join', 'customer', NULL, 'c_custkey,c_mktsegment'), ('join', 'orders', NULL, 'o_orderkey,o_custkey'), ('join', 'lineitem', NULL, 'l_orderkey'), ('group', 'lineitem', NULL, 'l_tax,l_returnflag')) AS t(frame, source, \"limit\", columns)")
_own("explain_plan", _explained, "SELECT place::INTEGER AS place, line FROM (VALUES (0, 'Limit[3] Schema(r_name: Utf8)'), (1, '  Project[r_name=e1] Schema(r_name: Utf8)'), (2, '    Filter[e2] Schema(r_regionkey: Int32, r_name: Utf8)'), (3, '      Scan[region; id=region] Schema(r_regionkey: Int32, r_name: Utf8)'), (4, 'Expressions'), (5, '  e1 = column(1)'), (6, '  e2 = >(e3, e4)'), (7, '  e3 = column(0)'), (8, '  e4 = literal(Int32)')) AS t(place, line)")
_own("table_show", _shown, "WITH r AS (SELECT r_regionkey AS k, r_name AS n, row_number() OVER (ORDER BY r_regionkey) AS i FROM region), w AS (SELECT max(len(n)) AS w FROM r WHERE i <= 4) SELECT 0::INTEGER AS at, '|r_regionkey|' || rpad('r_name', greatest(w, 6)::INTEGER, ' ') || '|' AS line FROM w UNION ALL SELECT 1, '|-----------|' || repeat('-', greatest(w, 6)::INTEGER) || '|' FROM w UNION ALL SELECT (i + 1)::INTEGER, '|' || rpad(k::VARCHAR, 11, ' ') || '|' || rpad(n, greatest(w, 6)::INTEGER, ' ') || '|' FROM r, w WHERE i <= 4 UNION ALL SELECT 6, '… +' || (count(*) - 4) || ' rows' FROM r UNION ALL SELECT * FROM (VALUES (7, 'Schema'), (8, '0. r_regionkey: Int32 required'), (9, '1. r_name: Utf8 required'))")
_own("table_cells", _cells, "SELECT r_regionkey AS k, r_name AS by_row, r_name AS by_column, r_name AS by_class, r_regionkey AS again FROM region")
_own("own_source", _own_source, "SELECT range AS n FROM range(51, 100)")
_own("own_sink", _own_sink, "SELECT * FROM nation")
_own("engine_policies", _policies, "SELECT * FROM (VALUES ('Auto', 'text', '1'), ('Auto', 'rows', '1'), ('ReferenceOnly', 'text', '1'), ('ReferenceOnly', 'rows', '1'), ('RequireColumnar', 'text', 'NotColumnar'), ('RequireColumnar', 'rows', '1')) AS t(policy, source, outcome)")
_own("header_inspection", _headers, "SELECT place::INTEGER AS place, name FROM (VALUES (0, 'c_custkey'), (1, 'a \"name\", quoted' || chr(10) || 'and long'), (2, 'c_nationkey'), (3, 'c_acctbal'), (4, 'c_mktsegment')) AS t(place, name)")
_own("csv_cells_beyond_lines", _stream_text, "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(13) || chr(10) || '\"x\", ' || c_mktsegment WHEN c_custkey % 3 = 1 THEN '' END AS t FROM customer")
_own("csv_roundtrip", _csv_roundtrip, "SELECT * FROM orders")
_own("tsv_text_roundtrip", _tsv_text_roundtrip, "SELECT * FROM nation")
_own("csv_native_roundtrip", _csv_native, "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_own("arrow_roundtrip", _arrow_roundtrip, "SELECT * FROM supplier")
_own("rows_source", _rows, "SELECT * FROM region")
_own("stream_filter", _stream, "SELECT p_partkey, p_size FROM part WHERE p_size > 30")
