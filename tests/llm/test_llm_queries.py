"""Every query runs on the smallest tables, and gives the rows of its SQL where it has one."""

import os

import duckdb
import pytest

from tallyforge.llm import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def test_each_problem_has_its_queries():
    names = queries.queries()
    assert {n[1] for n in names} == set("12356789")
    assert set(oracles.oracle_sql()) <= set(names)


def plain(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_rows_equal_those_of_the_sql(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    if name not in oracles.oracle_sql():
        assert df.count() > 0
        return
    done = sql.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(df.collect()) == ordered([r[names.index(c)] for c in df.columns] for r in done.fetchall())
