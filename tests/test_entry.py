"""The driver's entry points, with and without the optional training-data folder."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_twins_of_registered_queries(spark):
    assert __spark_entry__.entry(spark).columns == ["session_id", "channel", "part", "text", "raw_text", "first_raw_text"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_optional_folder(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/tapeloom", tmp_path / "tapeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.queries()) == set(e.oracle_sql())"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}
    )
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "mix_down" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]


def test_nothing_else_imports_the_optional_folder():
    for folder, _, files in os.walk(f"{ROOT}/tapeloom"):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in (f for f in files if f.endswith(".py")):
            with open(os.path.join(folder, name)) as source:
                assert "tapeloom.llm" not in source.read(), name
