"""The library without the corpus operators and their pipeline: it imports, registers its queries and collects its tests."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(top, *args):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTEST_CURRENT_TEST")}
    return subprocess.run([sys.executable, "-B", *args], cwd=top, env=env, capture_output=True, text=True, timeout=300)


def test_the_rest_without_the_corpus_folders(tmp_path):
    top = tmp_path / "copy"
    shutil.copytree(TOP, top, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json", "spark-warehouse", ".pytest_cache"))
    assert not (top / "sedimark" / "llm").exists() and not (top / "tests" / "llm").exists()
    got = run(top, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)")
    assert not got.returncode, got.stderr
    # collected here, run in full where the folders are removed for good
    got = run(top, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider")
    assert not got.returncode, got.stdout
    got = run(top, "-m", "pytest", "tests/test_rules.py", "-x", "-q", "-p", "no:cacheprovider", "-k", "not nothing")
    assert not got.returncode, got.stdout


def test_a_missing_package_of_the_corpus_operators_leaves_the_rest(tmp_path):
    """With zstandard gone, the other queries are there."""
    (tmp_path / "zstandard.py").write_text("raise ImportError('not here')")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q"
    got = run(TOP, "-c", code)
    assert not got.returncode, got.stderr


def test_nothing_else_imports_the_corpus_operators():
    for top, _, names in os.walk(os.path.join(TOP, "sedimark")):
        for name in names:
            if name.endswith(".py") and f"{os.sep}llm" not in top:
                with open(os.path.join(top, name)) as f:
                    assert "sedimark.llm" not in f.read(), name
