import subprocess
import sys

import __spark_entry__ as entry


def test_registered():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 40


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_llm_folders(tmp_path):
    """The entry module imports and has its other queries where the subpackage and the pipeline are absent."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert n and 'pipeline' not in n and not any(x.startswith('op') for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
