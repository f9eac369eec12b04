import os
import subprocess
import sys
from pathlib import Path

import pytest

from millrace.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_flagship_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5


@pytest.mark.parametrize("absent", ["millrace.llm", "ahocorasick"])
def test_queries_without_a_part_or_a_dependency(absent):
    """The other queries work where millrace.llm, or something it needs, cannot be imported."""
    code = f"import sys; sys.modules['{absent}'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1], check=True)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))]


def test_queries_with_a_broken_dependency(tmp_path):
    """A library whose own parts cannot be loaded raises ImportError as it stands."""
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('libmissing.so: cannot open shared object file')")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, check=True)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))]
