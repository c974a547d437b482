import pytest
from oracle_check import compare, connect

import __spark_entry__ as registered
from ledgerloom.workload import oracle
from ledgerloom.workload import queries as workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_match():
    assert set(workload.queries()) <= set(registered.queries())
    assert set(workload.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, registered.queries()[name], registered.oracle_sql()[name]) is None


def test_entry(spark):
    assert registered.entry(spark).count() > 20


def test_shuffle_partitions_do_not_matter(spark):
    query = registered.queries()["all_statements"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = sorted(query(spark, SF).collect())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert sorted(query(spark, SF).collect()) == expected
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert sorted(query(spark, SF).collect()) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_reaches_the_scan(spark):
    plan = _plan(registered.queries()["filter_year"](spark, SF))
    assert plan.count("GreaterThanOrEqual(") >= 2 and plan.count("LessThan(") >= 2


def test_one_scan_per_table_for_all_statements(spark):
    plan = _plan(registered.queries()["all_statements"](spark, SF))
    assert plan.count("FileScan") <= 2 * plan.count("== Initial Plan ==") + 2
    assert "Python" not in plan
