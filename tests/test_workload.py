"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import LLM, entry, oracle_sql, queries
from conftest import SMALL
from tools.check_queries import TABLES, canonical

SQL = oracle_sql()


@pytest.fixture(scope="module")
def database():
    made = duckdb.connect()
    for table in TABLES:
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(set(queries()) - set(LLM)))
def test_query(spark, database, name):
    frame = queries()[name](spark, SMALL)
    got = [tuple(r) for r in frame.collect()]
    if name not in SQL:
        assert got
        return
    cursor = database.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert canonical(frame.columns, got) == canonical(names, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).agg(F.count(F.lit(1))).first()[0] > 0


def test_unsqlable_queries_are_few():
    assert set(queries()) - set(LLM) - set(SQL) == {"train_and_score"}
