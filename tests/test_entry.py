"""The driver's contract in a checkout without the subpackage of text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'current_state' in q and 'current_state' in o; print(*(k for k in {**q, **o} if k.startswith('op') and k[2].isdigit() or k == 'pipeline'))"


@pytest.mark.parametrize("gone", [("kelpline/llm",), ("corpus_pipeline.py",), ("kelpline/llm", "corpus_pipeline.py")])
def test_entry_without_text_operators(tmp_path, gone):
    there = ("__spark_entry__.py", "kelpline", "corpus_pipeline.py")
    if not all(os.path.exists(f"{ROOT}/{x}") for x in (*there, *gone)):
        pytest.skip("this checkout has no text operators")
    for x in there:
        (shutil.copytree if os.path.isdir(f"{ROOT}/{x}") else shutil.copy)(f"{ROOT}/{x}", tmp_path / x)
    for x in gone:
        (shutil.rmtree if os.path.isdir(tmp_path / x) else os.remove)(tmp_path / x)
    said = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert "pipeline" not in said.stdout.split() and bool(said.stdout.split()) == ("kelpline/llm" not in gone)


def test_entry_without_a_library_of_the_text_operators(tmp_path):
    """A module that can't be imported stands in for one that isn't installed."""
    (tmp_path / "tiktoken.py").write_text("raise ImportError('not here')")
    said = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=ROOT, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert not said.stdout.split()
