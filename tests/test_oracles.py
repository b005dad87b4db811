"""Every query that SQL can state, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from chatloom.plans import analytics, conversations, files, ordering, registry, streams, workers  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.6g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, df.collect())
    for g, w in zip(got, rows(want.columns, want.fetchall()), strict=True):
        assert g == w


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
