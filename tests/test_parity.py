"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

import glob
import os
from datetime import datetime

import duckdb
import pytest
from fathom.plans import library

SF = "/root/testdata/sf0.001"


def _plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_same_rows(spark, duck, name):
    ours = library.QUERIES[name](spark, SF)
    theirs = duck.execute(library.SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    a, b = _rows(ours.columns, ours.collect()), _rows(names, theirs.fetchall())
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_gives_rows(spark, name):
    """Queries that SQL can't express give rows; what they give is compared with loops elsewhere."""
    assert library.QUERIES[name](spark, SF).count() > 0
