"""Each core query with SQL gives the rows of its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyforge.plans import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple(map(str, r)))


def near(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 2e-5 + 1e-9 * abs(a)
    return a == b


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_rows_equal_those_of_the_sql(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    done = sql.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(df.columns)
    expected = ordered([r[names.index(c)] for c in df.columns] for r in done.fetchall())
    got = ordered(df.collect())
    assert len(got) == len(expected) and all(near(x, y) for r, s in zip(got, expected) for x, y in zip(r, s))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
