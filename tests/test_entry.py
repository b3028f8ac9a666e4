"""The entry's optional part: absent is passed over, broken is an error."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def copy(tmp_path):
    to = tmp_path / "repo"
    to.mkdir()
    shutil.copytree(f"{ROOT}/candleflow", to / "candleflow", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", to)
    return to


def names(to):
    return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=to,
                          env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)


def test_without_the_optional_part(tmp_path):
    out = names(copy(tmp_path))
    assert out.returncode == 0 and "feature_table" in out.stdout and "pipeline" not in out.stdout.split()


def test_a_broken_optional_part_is_an_error(tmp_path):
    to = copy(tmp_path)
    (to / "candleflow" / "llm").mkdir()
    (to / "candleflow" / "llm" / "__init__.py").write_text("")
    (to / "corpus_pipeline.py").write_text("from candleflow.llm import nothing_here\n")
    out = names(to)
    assert out.returncode != 0 and "nothing_here" in out.stderr
