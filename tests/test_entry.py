"""The driver's contract, also without the training-data package."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).parent.parent


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 80 and set(sql) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() > 0


def test_without_training_data_package(tmp_path):
    for name in ("__spark_entry__.py", "lodestrand"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    package = tmp_path / "lodestrand"
    package.mkdir()
    for p in (REPO / "lodestrand").iterdir():
        if p.name != "llm":
            (package / p.name).symlink_to(p)
    (package / "llm" / "__pycache__").mkdir(parents=True)  # what may be left of it
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), len(e.queries()) > 50)"], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert said.stdout.split() == ["0", "True"], said.stderr[-500:]
