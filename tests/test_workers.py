"""Python workers must not need an installed copy of the package.

A fresh process outside the repository (its own working directory, the repo
only on the driver's sys.path) runs the two Python-worker paths: the
Monte-Carlo draws and the grouped enumeration for tables over three rows.
"""

import os
import subprocess
import sys
import tempfile

from tests.conftest import ROOT

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from matingstats.operators.fisher import fisher_monte_carlo, fisher_rx2
t = spark.createDataFrame([("g", "a", 4, 6), ("g", "b", 1, 9), ("g", "c", 7, 3), ("g", "d", 2, 8)],
                          "g string, r string, x long, y long")
print("MC", fisher_monte_carlo(spark, t, "x", "y", B=2000, seed=1).first()["p_value"])
print("RX", fisher_rx2(t, ["g"], "r", "x", "y").first()["p_value"])
spark.stop()
"""


def test_python_workers_run_outside_the_repository():
    cwd = tempfile.mkdtemp(prefix="workers-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = dict(l.split(" ", 1) for l in out.stdout.splitlines() if l[:2] in ("MC", "RX"))
    assert abs(float(lines["RX"]) - 0.0364685275) < 1e-9
    assert 0.0 < float(lines["MC"]) < 0.2
