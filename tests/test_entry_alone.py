"""The library and its entry module without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT


def alone(folder):
    """The environment of a child that finds the copy first, and else all that this process finds, but not the repository."""
    own = {os.path.realpath(ROOT), os.path.realpath(f"{ROOT}/tests"), os.path.realpath(f"{ROOT}/tests/llm")}
    others = [p for p in sys.path if p and os.path.realpath(p) not in own]
    return os.environ | {"PYTHONPATH": os.pathsep.join([str(folder), *others])}


def test_entry_works_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/brindle", tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()) and 'agg_basic' in q and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=alone(tmp_path), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 100


def test_the_rest_works_with_both_folders_deleted_and_the_pipeline_left(tmp_path):
    shutil.copytree(f"{ROOT}/brindle", tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{ROOT}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    env = alone(tmp_path)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert set(q) == set(e.oracle_sql()) and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout
    try:
        import duckdb  # noqa: F401

        some = "scan_table or watermarks"
    except ModuleNotFoundError:
        some = "watermarks"
    one = subprocess.run([sys.executable, "-m", "pytest", "tests", "-x", "-q", "-k", some], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert one.returncode == 0, one.stdout
