import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-W", "ignore", "-c", SAY], cwd=folder, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    return said.stdout.rpartition("NAMES ")[2].split()


def test_reader_queries_stay_without_the_optional_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    left = names(copy)  # corpus_pipeline.py is there, but what it needs isn't
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(copy) == left and "scan_raw" in left and not any(n.startswith("op") or n == "pipeline" for n in left)
    assert set(left) <= set(names(HERE))
