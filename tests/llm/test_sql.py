"""Each query of the package that SQL can express against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from noticelake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    expected = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert rows and rows == sorted(expected.fetchall(), key=repr)
