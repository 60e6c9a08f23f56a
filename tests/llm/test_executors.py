"""Executors need no copy of the package: what is sent to them carries its classes along."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
for name, query in entry.queries().items():
    if name.split("_")[0] in ("op2", "op3", "op8", "op11", "op12", "op13"):
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
print("all answered")
"""


def test_queries_run_where_workers_cannot_import_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=repo, shared=str(tmp_path / "shared"))
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all answered" in run.stdout, run.stderr[-3000:]
