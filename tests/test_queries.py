"""Every query against its SQL on the smallest tables; no part of this needs the optional subpackage."""

import math
from pathlib import Path

import duckdb
import pytest

from loomgraph.plans.oracle import SQL
from loomgraph.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    if name not in SQL:
        assert got.count() >= 0
        return
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    have = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr)
    assert have == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
