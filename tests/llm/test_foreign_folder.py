"""Jobs carry their own code: executors need not be able to import this repository."""

import os
import subprocess
import sys

import pytest

DIR = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.warehouse.dir", sys.argv[2] + "/w").getOrCreate()
for name in ("op1_bpe", "op2_language_id", "op8_toxicity", "op9_quality"):
    __spark_entry__.queries()[name](spark, sys.argv[3]).write.format("noop").mode("overwrite").save()
    print("done", name)
"""


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE, REPO, str(tmp_path / "shared"), DIR], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.stdout.count("done") == 4, run.stderr[-3000:]
