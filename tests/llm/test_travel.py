"""The queries run where executors have no copy of the package: all that tasks need comes with the job."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.local.dir", ".").config("spark.checkpoint.dir", "shared").getOrCreate()

def importable(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("penumbra") is not None))

assert spark.range(1).mapInPandas(importable, "id long").first().id == 0
from penumbra.llm.queries import QUERIES
import corpus_pipeline
for name, query in QUERIES.items():
    assert query(spark, {sf!r}).count() > 0, name
assert corpus_pipeline.run(spark, {sf!r}).count() > 0
"""


def test_queries_run_without_the_package_on_executors(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, sf=sf)], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert ran.returncode == 0, ran.stderr[-3000:]
