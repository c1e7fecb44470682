"""Queries that run mailspark code inside Python workers work from any working directory."""
import os
import subprocess
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
n1 = E.queries()["score_pipeline"](spark, "/root/testdata/sf0.001").count()
n2 = E.queries()["strip_html"](spark, "/root/testdata/sf0.001").count()
print("OK", n1, n2)
"""

STREAM = f"""
import os, sys, tempfile
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
from mailspark.streaming.ingest import ingest_stream
d = tempfile.mkdtemp()
os.makedirs(d + "/in")
with open(d + "/in/a.mbox", "w") as f:
    f.write("From a Mon Jan 01 00:00:00 2024\\nMessage-ID: <x>\\n\\nb\\n")
q = ingest_stream(spark, d + "/in", d + "/t", d + "/ck", eof_complete=True)
q.processAllAvailable()
q.stop()
print("OK", spark.read.parquet(d + "/t").count())
"""


@pytest.mark.parametrize("script", [SCRIPT, STREAM])
def test_python_worker_code_runs_from_foreign_cwd(script):
    cwd = tempfile.mkdtemp(prefix="deploy-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "OK" in out.stdout, out.stderr[-3000:]
