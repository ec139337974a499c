import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), set(e.oracle_sql()) <= set(q), sum(n.startswith('op') for n in q))"


def run(folder):
    out = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return out.stdout.strip().splitlines()[-1].split()


def test_names_need_no_session():
    n, sql, subset, _ = run(REPO)
    assert int(n) >= 150 and int(sql) >= 150 and subset == "True"


def test_entry_without_the_training_data_operators(tmp_path):
    target = tmp_path / "repo"
    shutil.copytree(REPO, target, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    n, _, subset, ops = run(target)
    assert int(n) >= 150 and subset == "True" and ops == "0"
