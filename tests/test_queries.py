"""Registered queries beside their SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
NAMES = sorted(entry.catalogue.QUERIES)


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for t in compare.TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return found


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF)
    rows = got.toPandas()
    if name in entry.catalogue.ORACLE:
        found = db.execute(entry.catalogue.ORACLE[name])
        columns = [c[0] for c in found.description]
        assert sorted(rows.columns) == sorted(columns)
        assert compare.equal(rows, columns, found.fetchall())
    else:
        assert len(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_text_operators(tmp_path):
    """The rest must work, and its tests pass, in a tree that lacks the subpackage, its tests and the pipeline."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("wavequill", "tests", "__spark_entry__.py", "bench.py", "compare.py"):
        subprocess.run(["cp", "-r", f"{here}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "wavequill/llm"), str(tmp_path / "tests/llm")], check=True)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'xcorr_vs' in q and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
    tests = ["tests/test_dsp.py", "tests/test_operators.py", "tests/test_sources.py", "tests/test_queries.py"]
    chosen = "test_entry or xcorr_vs or stack or names or panels or archives or blocks"
    out = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *tests, "-k", chosen], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stdout[-3000:]


def test_with_text_operators_that_cannot_be_imported(tmp_path):
    here = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("wavequill", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{here}/{name}"):
            subprocess.run(["cp", "-r", f"{here}/{name}", str(tmp_path)], check=True)
    (tmp_path / "wavequill/llm").mkdir(exist_ok=True)
    (tmp_path / "wavequill/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'xcorr_vs' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
