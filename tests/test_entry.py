"""The entry module, whole and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")])
    code = "import __spark_entry__ as e; q = e.queries(); assert 'iv_count' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_errors_inside_the_corpus_operators_are_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")])
    (tmp_path / "r" / "tessera" / "llm").mkdir()
    (tmp_path / "r" / "tessera" / "llm" / "__init__.py").touch()
    (tmp_path / "r" / "tessera" / "llm" / "registry.py").write_text("import a_module_that_is_not_there")
    (tmp_path / "r" / "corpus_pipeline.py").touch()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "r", env=env, capture_output=True, text=True)
    assert got.returncode and "a_module_that_is_not_there" in got.stderr
