"""Every registered query that has an oracle, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from folioflow import plans
from folioflow.sources.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def rows(values) -> list[str]:
    return sorted(str([plain(v) for v in r]) for r in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(plans.ORACLES[name])
    assert columns == sorted(want.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({plans.ORACLES[name]})").fetchall()
    assert rows(got.select(*columns).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
