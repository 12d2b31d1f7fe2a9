"""The package is not installed on executors: its functions travel with the tasks."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
found = entry.entry(spark).count()
stopped = entry.queries()["stream_scroll_stop"](spark, {sf_dir!r}).count()
print("rows", found, stopped)
"""


def test_from_another_folder_with_a_plain_session(sf_dir, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo, sf_dir=sf_dir)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    _, found, stopped = done.stdout.split()[-3:]
    assert int(found) > 0 and int(stopped) > 0
