"""Every query runs; those with SQL give what the SQL gives."""

import pytest
from compare import connection, differences

from lectern.plans.queries import QUERIES
from lectern.plans.sql import ORACLE


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    assert con.execute(f"SELECT count(*) FROM ({ORACLE[name]})").fetchone()[0] > 0  # nothing compared with nothing is no proof
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    found.write.format("noop").mode("overwrite").save()  # every row and column is computed
    assert found.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    assert int(out.stdout) >= len(QUERIES)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["duration_guards"](spark, sf_dir)._jdf.queryExecution().toString()
    pushed = plan.rsplit("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert pushed == "IsNotNull(text)"
    assert "ReadSchema: struct<chunk_id:bigint,text:string>" in plan
