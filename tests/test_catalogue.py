"""Every registered query with an oracle gives what its SQL gives in DuckDB."""

import os

import duckdb
import pytest

from mnemospark.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for file in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return c


def _sorted(rows):
    return sorted(tuple("~" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = _sorted(tuple(r) for r in df.select(columns).collect())
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        place = [names.index(c) for c in columns]
        assert got == _sorted(tuple(r[i] for i in place) for r in cursor.fetchall())
    assert len(df.columns) == len(set(df.columns))
