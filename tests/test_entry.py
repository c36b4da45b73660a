"""The entry points with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_works_without_the_training_data_part(tmp_path, with_pipeline):
    """A copy without that subpackage, with and without the pipeline's file, lists all other queries."""
    shutil.copytree(f"{ROOT}/penumbra", tmp_path / "penumbra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline else [])]:
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as e, penumbra.registry as r; assert e.queries().keys() == r.queries().keys() and e.oracle_sql() == r.oracle_sql()"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert ran.returncode == 0, ran.stderr


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "altitude" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
