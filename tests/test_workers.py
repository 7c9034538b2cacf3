"""Workers need no copy of the package: a job started in an empty folder finds all its functions."""

import os
import pathlib
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from placerank.operators import expansion
words = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.1]), ("z", [0.0, 1.0])], "word string, vector array<double>")
terms = spark.createDataFrame([(1, "x", 1)], "query_id int, term string, scope int")
print("FOUND", sorted(r.matched for r in expansion.expand_terms(terms, words).collect()))
"""


def test_from_an_empty_folder(tmp_path):
    root = str(pathlib.Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND ['x', 'y']" in done.stdout, done.stderr[-2000:]
