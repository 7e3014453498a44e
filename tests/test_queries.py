"""Every registered query against its SQL, on the given tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from workload.catalog import CATALOG

SF_DIR = os.environ.get("ROLLBOOK_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "orders", "lineitem")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(name, spark, duck):
    df = contract.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()

    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    assert len(want) > 0
    assert rows_of(df.columns, got) == rows_of(columns, want)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_column_types_equal_sql(name, spark, duck):
    """Integers, floats, dates and text have the same Python type on both sides."""
    df = contract.queries()[name](spark, SF_DIR)
    kinds = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    }
    spark_types = {f.name: kinds[f.dataType.simpleString()] for f in df.schema.fields}
    described = duck.execute(f"DESCRIBE {contract.oracle_sql()[name]}").fetchall()
    assert spark_types == {row[0]: row[1] for row in described}


def test_entry_counts_the_package(spark):
    got = {r["region"]: r["package_same_month"] for r in contract.entry(spark).collect()}
    assert got == {"COR": 52, "LER": 43, "NRR": 42, "UER": 45, "WKR": 51}
