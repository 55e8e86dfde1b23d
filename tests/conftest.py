import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.caseSensitive", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def run(spark):
    """run(frame, (schema, rows)...) -> list of rows; the sources are s0, s1, ..."""
    from plumbframe import FrameRuntime, SourceRef, rows_binding

    def go(build, *inputs, strict_zero=False):
        bindings = [rows_binding(rows, schema, SourceRef.values(f"s{i}")) for i, (schema, rows) in enumerate(inputs)]
        frame = build(*[b.frame for b in bindings])
        return list(FrameRuntime(spark, *bindings, strict_zero=strict_zero).collect(frame).rows())

    return go
