"""The driver may import the entry module by path from any working directory.

Python workers then cannot import the package; the pandas UDFs must travel by
value.  Runs in a subprocess with a foreign working directory.
"""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

from conftest import ROOT, SF001

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spec = importlib.util.spec_from_file_location("spark_entry", "{ROOT}/__spark_entry__.py")
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
print("ENTRY", m.entry(spark).count())
print("SUMMARY", m.queries()["hypothesis_summary"](spark, "{SF001}").count())
"""


def test_entry_and_udfs_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="ordersight-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600
    )
    assert "ENTRY 4" in out.stdout, out.stderr[-2000:]
    assert "SUMMARY 9" in out.stdout, out.stderr[-2000:]
