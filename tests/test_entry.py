"""The driver's entry with and without the training-data subpackage and what it needs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); print('page_title' in q, any(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def ask(folder, before=""):
    done = subprocess.run([sys.executable, "-B", "-c", before + ASK], cwd=folder, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    return done.stdout.split() if done.returncode == 0 else done.stderr


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/pagewright", tmp_path / "pagewright", ignore=shutil.ignore_patterns("__pycache__"))
    return tmp_path


def test_without_the_subpackage(copy):
    shutil.rmtree(copy / "pagewright" / "llm", ignore_errors=True)
    assert ask(copy) == ["True", "False", "False", "True"]
    if (copy / "corpus_pipeline.py").exists():
        (copy / "corpus_pipeline.py").unlink()
    assert ask(copy) == ["True", "False", "False", "True"]


def test_without_a_package_that_it_needs(copy):
    assert ask(copy, "import sys; sys.modules['zstandard'] = None; ") == ["True", "False", "False", "True"]


def test_a_broken_pipeline_is_an_error(copy):
    if not (copy / "pagewright" / "llm").exists():
        pytest.skip("the subpackage is gone")
    assert ask(copy) == ["True", "True", "True", "True"]
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert "no_such_module" in ask(copy)
    (copy / "corpus_pipeline.py").unlink()
    assert ask(copy) == ["True", "True", "False", "True"]
