import os
import subprocess
import sys
from pathlib import Path

from chronoloom.llm import queries

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from chronoloom.llm import queries

for name, query in queries.QUERIES.items():
    scratch = tempfile.mkdtemp(prefix="spark-fresh-")
    spark = (
        SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", scratch + "/shared").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    print("rows of", name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
    spark.stop()
"""


def test_each_query_runs_alone_in_a_new_session(tmp_path):
    """In another folder, without a path to the package for the workers: the session itself must send it to them."""
    (tmp_path / "run.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "run.py", str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    rows = [line.split() for line in done.stdout.splitlines() if line.startswith("rows of")]
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(rows) == len(queries.QUERIES) and all(int(r[3]) > 0 for r in rows)
