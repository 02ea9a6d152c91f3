"""The package reaches the Python workers even when the driver's working directory is elsewhere."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
df = E.queries()["noise_delete"](spark, "/root/testdata/sf0.001")
print("LEN", df.selectExpr("sum(length(text_perturbed)) AS s").collect()[0].s)
"""


def test_udfs_run_from_a_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="tremor-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "LEN" in out.stdout, out.stderr[-2000:]
