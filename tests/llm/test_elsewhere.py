"""Tasks need no installed copy of the library: the driver alone knows where it lies."""

import os
import subprocess
import sys

import stutter

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from stutter.llm.language_id import identified, language_id
from stutter.llm.near_vectors import near_vectors
from stutter.llm.periodic_runs import periodic_runs
from stutter.llm.whitening import whiten
docs = spark.createDataFrame([(i, "ab cd ef " * 12, "xy", "s", 9) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
counts = [x.count() for x in (language_id(docs), identified(docs), periodic_runs(docs), near_vectors(vectors), whiten(vectors))]
print(counts)
assert counts == [9, 9, 9, 9, 9]
"""


def test_without_the_package_on_workers(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.abspath(stutter.__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE, home], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
