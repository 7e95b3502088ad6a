import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

import __spark_entry__ as entry  # noqa: E402

from gapwright.plans import registry  # noqa: E402


def test_names_and_oracles():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) >= 35


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_all_else_works_without_the_deleted_folders(tmp_path, with_pipeline):
    """Both folders of the training-data operators deleted, the pipeline file still there or gone too."""
    here = Path(__file__).parents[1]
    for name in ("gapwright", "tests"):
        shutil.copytree(here / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if with_pipeline else [])):
        shutil.copy(here / name, tmp_path / name)
    code = (
        "import __spark_entry__ as e; names = e.queries(); e.oracle_sql(); assert len(names) >= 35;"
        "assert not any(n.startswith('op') for n in names) and 'pipeline' not in names; import bench"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], check=True, cwd=tmp_path, env=env, stdout=subprocess.DEVNULL)
