"""Every query against its SQL on the smallest tables, and that none comes back empty."""

import os

import duckdb
import pytest

import quire.plans.body_queries  # noqa: F401
import quire.plans.case_queries  # noqa: F401
import quire.plans.more_queries  # noqa: F401
import quire.plans.package_queries  # noqa: F401
import quire.plans.table_queries  # noqa: F401
from quire.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def comparable(table):
    rows = [tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in (None if x != x else x for x in r)) for r in table.astype(object).where(table.notna(), None)[sorted(table.columns)].itertuples(index=False)]
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, expected = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and len(got)
    assert comparable(got) == comparable(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
