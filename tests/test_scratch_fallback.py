"""A local session without a checkpoint folder; runs in its own process, since a
session keeps the folder it started with."""

import os
import subprocess
import sys

CODE = """
from pyspark.sql import SparkSession
from chronolode.sources.scratch import checkpoint_folder, fixed_partitions, materialise
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = checkpoint_folder(spark)
assert folder == checkpoint_folder(spark)
assert fixed_partitions(spark.range(10), 2, "id").count() == 10
assert materialise(spark.range(4), "four").count() == 4
print("folder ok")
"""


def test_own_folder_when_none_is_set(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": here + os.pathsep + os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, env=env, timeout=180)
    assert "folder ok" in done.stdout, done.stderr[-2000:]
