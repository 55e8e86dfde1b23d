"""Workers that can't import the package run the operators all the same."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
for n in ("op2_toxicity", "op4_warc", "op5_bpe_counts", "op6_topk", "op7_secrets", "op8_jaccard", "op9_quality", "csv_roundtrip"):
    assert queries[n](s, {sf!r}).count() > 0, n
print("all ran")
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_workers_need_no_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]
