"""Every registered query against its SQL; those without SQL must give rows, or none where nothing matches."""

import pytest
from tests.oracle import connect, rows

from loam.plans.registry import ORACLE_SQL, QUERIES

MAY_BE_EMPTY = {"f09_all_secrets"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(con.execute(ORACLE_SQL[name]).df())
    else:
        assert len(got) or name in MAY_BE_EMPTY


def test_entry_imports_and_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q)


def test_entry_without_the_subpackage(tmp_path):
    """A copy without ``loam/llm`` (with and without the pipeline module) still lists all other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/loam", tmp_path / "loam", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{f}"):
            shutil.copy(f"{root}/{f}", tmp_path / f)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'b03_bm25' in q and not any(n.startswith('op') for n in q), sorted(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
