"""Every registered query against its SQL, both over the whole tables of the smallest scale factor."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def as_sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    found = df.collect()
    assert found, "a query over the whole tables has rows"
    cursor = oracle.execute(entry_point.oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert as_sorted(found, df.columns) == as_sorted(cursor.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry_point.queries()[name](spark, SF_DIR).collect()


def test_entry(spark):
    assert [r["model"] for r in entry_point.entry(spark).collect()]
