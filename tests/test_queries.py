"""Every query of the catalog runs, and equals its SQL where it has one."""

import pytest

from docloom.plans import catalog

from .oracle import compare, duck

SLOW = {"respond_batch"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, sf_dir, name):
    compare(spark, con, sf_dir, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).limit(5).collect()


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_reaches_the_scan(spark, sf_dir):
    df = catalog.queries()["question_hashes"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in plan
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan
