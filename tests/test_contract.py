import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from roadtrace.plans import catalogue

ROOT = Path(__file__).parent.parent


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no tables here")
    assert contract.entry(spark).count() > 0


def test_entry_imports_without_the_optional_parts(tmp_path):
    for part in ("roadtrace", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / part), str(tmp_path)], check=True)
    # In a repository without the folder there is nothing to take out.
    for kind in (("f",), ("d", "-empty")) if (tmp_path / "roadtrace" / "llm").exists() else ():
        subprocess.run(["find", str(tmp_path / "roadtrace" / "llm"), "-type", *kind, "-delete"], check=True)
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert int(out.stdout.split()[0]) == len(catalogue.queries())
