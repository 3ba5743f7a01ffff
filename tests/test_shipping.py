"""The package reaches Python workers that do not find it by themselves."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from shelfkin.operators.retrieve import encode_texts
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", len(encode_texts(spark.createDataFrame([(1, "a b")], "id int, text string")).collect()))
"""


def test_job_started_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert "rows 1" in out.stdout, out.stderr[-2000:]
