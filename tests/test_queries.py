"""Every registered query against its SQL twin, all rows and values."""

import duckdb
import pytest

import __spark_entry__ as entry

from replipulse.plans.catalog import QUERIES
from replipulse.plans.twins import TWINS

TABLES = ("nation", "supplier", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


def test_entry_runs(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["site_pos", "site", "connections", "async_links", "sync_pods"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_twin(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = [tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = con.execute(f"SELECT {quoted} FROM ({TWINS[name]})").fetchall()
    assert ours
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))
