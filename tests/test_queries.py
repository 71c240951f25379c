import __spark_entry__ as entry
import pytest
from compare import DATA, check

OWN = {k: v for part in entry.PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in entry.PARTS for k, v in part.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(spark, OWN[name], SQL[name])


@pytest.mark.parametrize("name", sorted(OWN.keys() - SQL.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert OWN[name](spark, str(DATA / "sf0.001")).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["region", "n", "mean", "median", "min", "max", "p25", "p75"]


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
