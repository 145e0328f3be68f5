import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_registry_is_whole():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and e.FLAGSHIP in q and len(q) > 100


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_flagship_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0 and df.columns == ["tbl", "project_id", "row_id", "field_name", "kind"]


def test_core_works_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(os.path.join(ROOT, "knowloom"), tmp_path / "knowloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p6_found' in q and not any(k.startswith('p1_') for k in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_core_queries_run_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(os.path.join(ROOT, "knowloom"), tmp_path / "knowloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    names = ["p6_found", "sea_01_bm25_all", "gra_05_communities", "dml_01_save", "src_09_ddl"]
    code = f"""
import importlib.util
import __spark_entry__ as e
from knowloom.runtime import session
assert importlib.util.find_spec("knowloom.llm") is None
spark, q = session("alone", cpus=4, shuffle=4, memory="2g"), e.queries()
for name in {names}:
    assert q[name](spark, {DATA!r}).count() > 0, name
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]
