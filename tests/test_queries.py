import pytest

from tests.oracle import connect, differences
from tidemark.queries import collect_all

SF = "/root/testdata/sf0.001"
REG = collect_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REG.sql))
def test_query_equals_sql(spark, con, name):
    assert not differences(spark, con, REG.queries[name], REG.sql[name], SF)


@pytest.mark.parametrize("name", sorted(set(REG.queries) - set(REG.sql)))
def test_query_without_sql_gives_rows(spark, name):
    df = REG.queries[name](spark, SF)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_names_can_be_read_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.returncode == 0, out.stderr
