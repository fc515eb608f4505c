"""Every query of the core against its SQL on the smallest tables."""

import os

import pytest

from corpusloom.plans import catalog
from tests import oracle

FOLDER = f"{oracle.DATA}/sf0.001"
QUERIES, SQL = catalog.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert oracle.rows(QUERIES[name](spark, FOLDER)) == oracle.sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns


def test_entry_works_without_the_llm_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpusloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); assert not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
