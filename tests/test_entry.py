"""The entry module on copies of the repository that lack a part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from callgauge.plans.queries import REGISTRY

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def copy(path, *left_out: str) -> str:
    target = str(path / "copy")
    shutil.copytree(os.path.join(ROOT, "callgauge"), f"{target}/callgauge", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), target)
    return target


def listed(target: str) -> subprocess.CompletedProcess:
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", LIST], cwd=target, capture_output=True, text=True, timeout=120, env=environment)


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_library_stands_without_the_subpackage(tmp_path, left_out):
    found = listed(copy(tmp_path, *left_out))
    assert found.stdout.split() == [str(len(REGISTRY))] * 2, found.stderr


def test_other_gaps_are_errors(tmp_path):
    found = listed(copy(tmp_path, "frames.py"))
    assert found.returncode != 0 and "frames" in found.stderr
