"""Delimited text, Arrow, Parquet, tables and the runtime."""

import dataclasses
import datetime
import math
import random

import pytest

from plumbframe import BOOL, FLOAT32, FLOAT64, INT32, INT64, TIMESTAMP, UTF8, EnginePolicy, Field, Frame, FrameRuntime, RuntimeBindingError, Schema, SinkError, SourceError, SourceRef, StorageError, Table, TableReadError, TimeUnit, arrow_bytes, arrow_ipc_binding, csv_options, dataframe_binding, delimited_binding, delimited_path_binding, header_names, parquet_binding, rows_binding, table_binding, timestamp, to_text, tsv_options, write_text
from plumbframe.errors import ExecutionError, OptionError, PlumbError, bounded, translated
from plumbframe.sources import Coercion, HeaderOptions, Limits, NullPolicy, header_names_of_path
from plumbframe.sources.delimited import records
from plumbframe.streaming import over_stream

D1 = Schema.of(id=INT32, label=UTF8, score=(FLOAT64, True))


def read(spark, text, schema, **options):
    return list(delimited_binding(text, csv_options(schema, **options)).collect(spark).rows())


def fails(cls, code, f):
    with pytest.raises(cls) as e:
        f()
    assert e.value.code == code, e.value


def test_csv_reads(spark):
    got = read(spark, 'id,label,score\n1,"a,b",1.5\n2,missing,\n3,nan,NaN\n', D1)
    assert got[:2] == [(1, "a,b", 1.5), (2, "missing", None)] and math.isnan(got[2][2])
    v = Schema.of(v=(UTF8, True))
    assert read(spark, 'v\n\n""\nnull\n"null"\n x \n', v) == [(None,), ("",), (None,), ("null",), (" x ",)]
    assert read(spark, 'v\r\na\r"b\r\n""c"\nd', v) == [("a",), ('b\r\n"c',), ("d",)]
    assert read(spark, "﻿v\n﻿a\n", v) == [("﻿a",)]
    assert read(spark, "v\n  null \n\" x \"\n", v, coercion=Coercion.TRIM_WHITESPACE) == [(None,), (" x ",)]
    assert read(spark, "1;true;-7\n", Schema.of(a=INT64, b=BOOL, c=timestamp()), delimiter=";", header=False) == [(1, True, datetime.datetime(1969, 12, 31, 23, 59, 59, 999993))]
    assert read(spark, b"v\n\xc3\xa9\n", v) == [("é",)]
    assert list(delimited_binding("a\tb\nx\t\"y\tz\"\n", tsv_options(Schema.of(a=UTF8, b=UTF8))).collect(spark).rows()) == [("x", "y\tz")]
    assert read(spark, "id,label,score\n", D1) == []


@pytest.mark.parametrize(
    ("text", "code"),
    [("id,label\n", "SchemaMismatch"), ("", "SchemaMismatch"), ("id,label,score\n1,a\n", "MalformedDelimited"), ("id,label,score\n1,a,1,2\n", "MalformedDelimited"), ('id,label,score\n1,a"b,1\n', "MalformedDelimited"), ('id,label,score\n1,"a"b,1\n', "MalformedDelimited"), ('id,label,score\n1,"a,1\n', "MalformedDelimited"), ("id,label,score\nx,a,1\n", "Decode"), ("id,label,score\n3000000000,a,1\n", "Decode"), ("id,label,score\n1,a,one\n", "Decode"), ("id,label,score\n1,,1\n", "RequiredColumnContainsNull"), (b"id,label,score\n1,\xff,1\n", "InvalidUtf8"), ('id,label,score\n"1" ,a,1\n', "MalformedDelimited")],
)
def test_csv_errors(spark, tmp_path, text, code):
    with pytest.raises(PlumbError) as e:
        read(spark, text, D1)
    assert code in (e.value.code, getattr(e.value.details.get("error"), "code", None))
    assert "one" not in e.value.message and len(e.value.message) <= 256
    (tmp_path / "a.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    if not text:
        return  # Spark passes over empty files
    with pytest.raises(PlumbError) as e:
        delimited_path_binding(f"file://{tmp_path}", csv_options(D1)).collect(spark)
    assert e.value.code == code


def test_option_checks():
    fails(OptionError, "EmptyTokens", lambda: NullPolicy(frozenset()))
    fails(OptionError, "WriteTokenNotRecognized", lambda: NullPolicy(frozenset({"x"}), "y"))
    fails(OptionError, "FieldExceedsRecord", lambda: Limits(10, 20))
    fails(OptionError, "NonPositiveRecord", lambda: Limits(0, 0))
    fails(SourceError, "InvalidRequest", lambda: csv_options(D1, delimiter='"'))
    fails(SourceError, "InvalidRequest", lambda: csv_options(D1, batch_size=0))
    with pytest.raises(SourceError):
        list(records("a,bbbbb", ",", Limits(100, 3)))
    with pytest.raises(SourceError):
        list(records('a,"bbb"\n', ",", Limits(5, 3)))


def test_round_trips(spark, tmp_path):
    s = Schema([Field("v", UTF8, True), Field("x,y", FLOAT64, True), Field("n", INT32), Field("f", FLOAT32, True), Field("b", BOOL, True)])
    rows = [(None, None, 1, None, None), ("", -0.0, 2, 0.1, True), ("null", 1e300, 3, 1.5, False), (" a", 0.1, 4, None, True), ("﻿q", math.inf, 5, 1e-7, None), ('say "hi", ok\r\n', -1e-5, 6, 3.0, None), ("é🙂", 12345678.9, -7, None, False), ("\t", 2.0, 0, None, None)]
    b = rows_binding(rows, s, SourceRef.values("r"))
    df = FrameRuntime(spark, b).dataframe(b.frame)
    for options in (csv_options(s), tsv_options(s), csv_options(s, delimiter=";", header=False), csv_options(s, nulls=NullPolicy(frozenset({"NA", ""}), "NA"))):
        text, receipt = to_text(df, options)
        assert receipt.rows == len(rows) and receipt.bytes == len(text.encode())
        assert list(delimited_binding(text, options).collect(spark).rows()) == list(b.collect(spark).rows())
        path = f"file://{tmp_path}/{abs(hash(options))}"
        write_text(df, path, options)
        assert sorted(delimited_path_binding(path, options).collect(spark).rows(), key=lambda r: r[2]) == sorted(b.collect(spark).rows(), key=lambda r: r[2])
    with pytest.raises(SinkError):
        to_text(df, csv_options(D1))


def test_native_route(spark, tmp_path):
    s = Schema.of(a=UTF8, b=(UTF8, True))
    o = csv_options(s, nulls=NullPolicy(frozenset({""}), ""))
    b = rows_binding([("x", None), ("y", ""), ('q"\n', "z,")], s, SourceRef.values("r"))
    write_text(FrameRuntime(spark, b).dataframe(b.frame).coalesce(1), f"file://{tmp_path}/n", o)
    p = delimited_path_binding(f"file://{tmp_path}/n", o)
    assert p.route == "spark.read.csv" and delimited_path_binding("x", csv_options(s)).route == "parser"
    assert sorted(p.collect(spark).rows()) == [('q"\n', "z,"), ("x", None), ("y", "")]


def test_headers(spark, tmp_path):
    assert header_names('a,"b,c",é\n1,2,"unclosed') == ["a", "b,c", "é"]
    assert header_names("a\tb", HeaderOptions(delimiter="\t")) == ["a", "b"]
    for bad in ("", "a,,b", "a,a", "a, "):
        fails(SourceError, "SchemaMismatch", lambda bad=bad: header_names(bad))
    fails(SourceError, "SchemaMismatch", lambda: header_names("a,b,c", HeaderOptions(max_columns=2)))
    (tmp_path / "h.csv").write_text('x,"y\nz"\n1,2\n')
    assert header_names_of_path(spark, f"file://{tmp_path}/h.csv") == ["x", "y\nz"]


def test_arrow(spark):
    s = Schema.of(i=INT32, l=(INT64, True), f=FLOAT32, d=(FLOAT64, True), b=BOOL, t=(UTF8, True), at=TIMESTAMP)
    rows = [(1, None, 1.5, math.inf, True, None, datetime.datetime(2020, 1, 2)), (2, 2**62, -0.5, None, False, "é", datetime.datetime(1960, 1, 2, 3, 4, 5, 6))]
    t = Table.from_rows(rows, s)
    back = arrow_ipc_binding(arrow_bytes(t), s).collect(spark)
    assert list(back.rows()) == rows and back.schema == s
    fails(SourceError, "Read", lambda: arrow_ipc_binding(b"nothing"))
    fails(SourceError, "SchemaMismatch", lambda: arrow_ipc_binding(arrow_bytes(t), D1))
    fails(SinkError, "InvalidRequest", lambda: arrow_bytes(Table.from_rows([(1,)], Schema.of(x=timestamp(TimeUnit.SECOND)))))


def test_tables():
    s = Schema.of(id=INT32, name=(UTF8, True), x=FLOAT64)
    t = Table.from_rows([(1, "a", 0.5), (2, None, 1e10), (3, "", -0.0)], s)
    assert t.row(1) == (2, None, 1e10) and t.cell(0, "name") == "a" and t.column("id") == [1, 2, 3]
    assert t.show() == "|id|name|x     |\n|--|----|------|\n|1 |a   |0.5   |\n|2 |null|1.0E10|\n|3 |\"\"  |-0.0  |"
    assert t.show(max_rows=1, max_width=9).endswith("\n… +1 cols\n… +2 rows")
    assert t.show(max_cell_width=1).startswith("|…|…|x|")
    assert t.show_schema() == "Schema\n0. id: Int32 required\n1. name: Utf8 optional\n2. x: Float64 required"
    assert Table.from_rows([(5,)], Schema.of(t=timestamp(TimeUnit.NANOSECOND))).show().endswith("|5@Nanosecond|")
    assert Table.from_rows([("🙂🙂🙂",)], Schema.of(t=UTF8)).show(max_cell_width=4).endswith("|🙂… |")

    @dataclasses.dataclass
    class R:
        id: int
        name: str | None
        x: float

    assert t.row_as(0, R) == R(1, "a", 0.5)
    assert list(Table.from_rows([R(1, "a", 0.5), {"id": 2, "name": None, "x": 1.0}], s).rows()) == [(1, "a", 0.5), (2, None, 1.0)]
    fails(TableReadError, "RowOutOfBounds", lambda: t.row(3))
    fails(TableReadError, "InvalidRenderOptions", lambda: t.show(max_width=7))
    fails(TableReadError, "InvalidBatchSize", lambda: Table.from_rows([], s, 0))
    fails(TableReadError, "InvalidValue", lambda: Table.from_rows([("x", None, 1.0)], s))
    fails(StorageError, "RequiredColumnContainsNull", lambda: Table.from_rows([(None, None, 1.0)], s))
    fails(TableReadError, "ColumnNotFound", lambda: t.column("no"))
    assert len(Table.from_rows([(), ()], Schema([]))) == 2


def test_runtime_checks(spark):
    s = Schema.of(id=INT32)
    a, b = rows_binding([(1,)], s, SourceRef.values("a")), rows_binding([(2,)], s, SourceRef.values("b"))
    fails(RuntimeBindingError, "DuplicateSource", lambda: FrameRuntime(spark, a, a))
    fails(RuntimeBindingError, "SingleSourceIdentityInMultiBinding", lambda: FrameRuntime(spark, a, rows_binding([(1,)], s)))
    with FrameRuntime(spark, a, b, policy=EnginePolicy.REQUIRE_COLUMNAR) as rt:
        assert list(rt.collect(a.frame.union_all(b.frame)).rows()) == [(1,), (2,)]
        fails(RuntimeBindingError, "MissingSource", lambda: rt.collect(Frame.source("c", s)))
        fails(RuntimeBindingError, "SourceSchema", lambda: rt.collect(Frame.source("a", Schema.of(id=INT64))))
        two = Frame.source("a", Schema.of(x=INT32)).inner_join(a.frame, lambda x, y: x["x"].eq(y["id"]))
        fails(RuntimeBindingError, "ConflictingPlanSchema", lambda: rt.collect(two))
    assert a.render(spark).splitlines()[-1] == "|1 |"


def test_parquet_pushdown_and_receipts(spark, tmp_path):
    s = Schema.of(a=INT32, b=(UTF8, True), c=FLOAT64)
    path = f"file://{tmp_path}/p"
    spark.createDataFrame([(i, str(i), float(i)) for i in range(50)], "a int, b string, c double").write.parquet(path)
    p = parquet_binding(path, s, SourceRef.scan("p"), verify_required=True)
    rt = FrameRuntime(spark, p)
    table, receipt = rt.collect_with_receipt(p.frame.filter(lambda r: (r["a"] > literal_int(40)).is_true()).select("a"))
    assert table.column("a") == list(range(41, 50))
    assert receipt.sources[0].requested.predicate is not None and receipt.sources[0].requested.limit is None
    assert receipt.engine == "spark" and receipt.sources[0].columns_read == ("a",) and any("GreaterThan" in x for x in receipt.sources[0].accepted)
    assert "ReadSchema" in rt.physical_explain(p.frame) and "incremental" in rt.stream_physical_explain(p.frame)
    fails(RuntimeBindingError, "Source", lambda: parquet_binding(path, Schema.of(zz=INT32)).collect(spark))
    fails(RuntimeBindingError, "Source", lambda: parquet_binding(path, Schema.of(a=INT64)).collect(spark))
    assert dataframe_binding(spark.range(3)).collect(spark).column("id") == [0, 1, 2]


def test_scan_requests():
    from plumbframe import scan_requests
    from plumbframe.functions.expr import Binary
    from plumbframe.plans.requests import Both, Compare, Either, IsNull

    f = Frame.source("s", Schema.of(a=INT32, b=(UTF8, True)))
    ask = lambda g: scan_requests(g.plan)["s"]
    assert (ask(f).limit, ask(f).predicate) == (None, None)
    assert ask(f.limit(3)).limit == 3 and ask(f.limit(9).limit(3)).limit == 9
    assert ask(f.filter(lambda r: (r["a"] > literal_int(1)) & r["b"].eq("x").is_true())).predicate == Both(Compare("a", Binary.GT, 1), Compare("b", Binary.EQ, "x"))
    assert ask(f.filter(lambda r: (literal_int(1) > r["a"]) | r["b"].is_null())).predicate == Either(Compare("a", Binary.LT, 1), IsNull("b"))
    assert ask(f.filter(lambda r: (r["a"] + literal_int(1)) > literal_int(1))).predicate is None
    assert ask(f.filter(lambda r: r["b"].is_not_null())).predicate is None
    assert ask(f.limit(2).union_all(f.limit(5))).limit == 5 and ask(f.limit(2).union_all(f)).limit is None
    p = lambda r: r["a"] > literal_int(1)
    assert ask(f.filter(p).union_all(f.filter(p))).predicate is not None and ask(f.filter(p).union_all(f)).predicate is None


def literal_int(n):
    from plumbframe import literal

    return literal(n, INT32)


def test_equi_joins_stay_equi_joins(spark):
    s, t = Schema.of(k=(FLOAT64, True), a=INT32), Schema.of(k=(FLOAT64, True), b=INT32)
    x, y = rows_binding([(1.0, 1)], s, SourceRef.values("x")), rows_binding([(1.0, 1)], t, SourceRef.values("y"))
    rt = FrameRuntime(spark, x, y)
    for f in (x.frame.inner_join_using(y.frame, "k"), x.frame.left_join_using(y.frame, "k"), x.frame.semi_join(y.frame, lambda l, r: l["k"].eq(r["k"]).is_true()), x.frame.anti_join(y.frame, lambda l, r: l["k"].eq(r["k"]))):  # noqa: E741
        plan = rt.physical_explain(f)
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_streams(spark, tmp_path):
    s = Schema.of(id=INT32)
    a, b = rows_binding([(i,) for i in range(10)], s, SourceRef.values("a")), rows_binding([(i,) for i in range(100, 103)], s, SourceRef.values("b"))
    rt = FrameRuntime(spark, a, b)
    parts, receipt = rt.stream_with_receipt(a.frame.union_all(b.frame), 4)
    tables = list(parts)
    assert [len(t) for t in tables] == [4, 4, 2, 3] and tables[3].column("id") == [100, 101, 102] and receipt.engine == "spark"
    assert [r for t in rt.stream(a.frame.limit(3)) for r in t.rows()] == [(0,), (1,), (2,)]
    fails(ExecutionError, "InvalidBatchSize", lambda: rt.stream(a.frame, 0))
    path = f"{tmp_path}/in"
    spark.createDataFrame([(1,), (5,)], "id int").write.parquet(path)
    source = Frame.source("s", s)
    live = over_stream(source.filter(lambda r: r["id"] > literal_int(2)).with_column("twice", lambda r: r["id"] * literal_int(2)), {"s": spark.readStream.schema("id int").parquet(path)})
    q = live.writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("live").collect()] == [(5, 10)]
    for f in (source.distinct(), source.sort_by("id"), source.limit(1), source.semi_join(source, lambda l, r: l["id"].eq(r["id"]))):  # noqa: E741
        fails(ExecutionError, "UnsupportedNode", lambda f=f: over_stream(f, {}))


def test_messages_are_bounded():
    assert len(bounded("x" * 1000)) == 256 and "\n" not in bounded("a\nb")
    e = ValueError("other")
    assert translated(e) is e


def test_random_text_round_trip(spark):
    rnd = random.Random(4)
    s = Schema.of(a=(UTF8, True), b=(UTF8, True))
    rows = [tuple(None if rnd.random() < 0.2 else "".join(rnd.choice('a,"\r\n\t é🙂') for _ in range(rnd.randint(0, 6))) for _ in range(2)) for _ in range(150)]
    b = rows_binding(rows, s, SourceRef.values("r"))
    text, _ = to_text(FrameRuntime(spark, b).dataframe(b.frame), csv_options(s))
    assert read(spark, text, s) == rows
    assert table_binding(Table.from_rows(rows, s)).collect(spark).column("a") == [r[0] for r in rows]


def test_csv_in_splits(spark, tmp_path):
    """Files of many splits, with and without cells that go beyond a line, are read as they are in one piece."""
    rnd = random.Random(8)
    s = Schema.of(id=INT32, t=(UTF8, True))
    o = csv_options(s)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for ends in ("", "\n", "\r\n"):
            rows = [(i, None if i % 7 == 0 else "".join(rnd.choice(f'a,"é {ends}') for _ in range(rnd.randint(1, 30)))) for i in range(3000)]
            df = FrameRuntime(spark, b := rows_binding(rows, s, SourceRef.values("r"))).dataframe(b.frame)
            text, _ = to_text(df, o)
            (tmp_path / "s.csv").write_text("\ufeff" + text, newline="")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
            binding = delimited_path_binding(f"file://{tmp_path}/s.csv", o)
            assert sorted(binding.collect(spark).rows()) == rows
            assert ends or binding.load(spark).rdd.getNumPartitions() > 3
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "bad.csv").write_bytes(b"id,t\n1,a\n2,\xff\n")
    with pytest.raises(SourceError) as e:
        delimited_path_binding(f"file://{tmp_path}/bad.csv", o).collect(spark)
    assert e.value.code == "InvalidUtf8" and "byte 11" in e.value.message
    (tmp_path / "three.csv").write_text("id,t\n1,a\n2,b\nx,c\n")
    with pytest.raises(SourceError) as e:
        delimited_path_binding(f"file://{tmp_path}/three.csv", o).collect(spark)
    assert e.value.code == "Decode" and "record 4" in e.value.message


def test_long_and_broken_headers(spark, tmp_path):
    long = "y\n" * 6000 + "z"
    (tmp_path / "h.csv").write_text(f'x,"{long}"\n1,2\n')
    assert header_names_of_path(spark, f"file://{tmp_path}/h.csv") == ["x", long]
    fails(SourceError, "InvalidUtf8", lambda: header_names(b"a,\xff\n"))
    assert header_names(b"a,b\n\xff") == ["a", "b"]


def test_sources_and_sinks_of_ones_own(spark):
    import io

    from plumbframe import ArrowSink, ScanPlan, source_binding

    asked = []

    class Source:
        def inspect(self, spark):
            return Schema.of(a=INT32, b=(UTF8, True), c=FLOAT64)

        def plan(self, spark, request):
            asked.append(request)
            df = spark.createDataFrame([(1, "x", 0.5), (2, None, 1.5), (3, "z", 2.5)], "a int, b string, c double")
            return ScanPlan(df.select(*request.columns), request.columns, ("columns",))

    binding = source_binding(spark, Source())
    table, receipt = FrameRuntime(spark, binding).collect_with_receipt(binding.frame.filter(lambda r: r["c"] > 1.0).select("b"))
    assert table.column("b") == [None, "z"] and asked[-1].columns == ("b", "c") and asked[-1].predicate is not None
    assert receipt.sources[0].columns_read == ("b", "c") and receipt.sources[0].accepted == ("columns",)
    out = io.BytesIO()
    assert FrameRuntime(spark, binding).write(binding.frame, ArrowSink(out), 2).batches == 2
    assert list(arrow_ipc_binding(out.getvalue()).collect(spark).rows()) == [(1, "x", 0.5), (2, None, 1.5), (3, "z", 2.5)]
    text = delimited_binding("a\n1\n", csv_options(Schema.of(a=INT32)), SourceRef.scan("t"))
    fails(RuntimeBindingError, "NotColumnar", lambda: FrameRuntime(spark, text, policy=EnginePolicy.REQUIRE_COLUMNAR).collect(text.frame))


def test_zeros_are_told_apart_and_literals_reach_the_scan(spark, tmp_path):
    s = Schema.of(x=FLOAT64)
    b = rows_binding([(0.0,), (-0.0,), (1.0,), (-1.0,)], s, SourceRef.values("z"))
    rt = FrameRuntime(spark, b)
    text = lambda f: [str(r[0]) for r in rt.collect(f).rows()]
    assert text(b.frame.sort_by("x")) == ["-1.0", "-0.0", "0.0", "1.0"]
    assert sorted(text(b.frame.filter(lambda r: r["x"] < 0.0))) == ["-0.0", "-1.0"]
    assert sorted(text(b.frame.filter(lambda r: r["x"] >= 0.0))) == ["0.0", "1.0"]
    path = f"file://{tmp_path}/z"
    spark.createDataFrame([(1.0,)], "x double").write.parquet(path)
    p = parquet_binding(path, s, SourceRef.scan("p"))
    assert any("GreaterThan(x,0.5)" in a for a in FrameRuntime(spark, p).collect_with_receipt(p.frame.filter(lambda r: r["x"] > 0.5))[1].sources[0].accepted)
