"""UDFs must import in the Python workers whatever the driver's working directory."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
import __spark_entry__ as E
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = E.queries()["score_fuzzy_location"](spark, "/root/testdata/sf0.001")
print("ROWS", df.count())
"""


def test_queries_run_from_another_directory():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as d:
        out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=d, env=env, capture_output=True,
                             text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-3000:]
