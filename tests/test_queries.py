"""Each notice query against its SQL on the smallest tables, compared as multisets of rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from noticelake.plans import queries


def plain(value):
    return None if value is None or value != value else value


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    expected = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    key = lambda row: repr(row)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=key)
    assert rows == sorted((tuple(map(plain, r)) for r in expected.fetchall()), key=key) and rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
