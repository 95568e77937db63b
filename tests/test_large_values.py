"""Registered queries whose values only grow large with their tables."""

import duckdb

from mnemospark.plans.catalogue import ORACLES, QUERIES


def test_sizes_of_gigabytes_and_terabytes(spark, tmp_path):
    keys = [1, 420, 429_497, 429_498, 1_200_000, 439_804_651, 439_804_652, 10**10]
    c = duckdb.connect()
    c.execute(f"COPY (SELECT unnest({keys})::BIGINT AS p_partkey, 50::INTEGER AS p_size) TO '{tmp_path}/part.parquet'")
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = sorted(tuple(r) for r in QUERIES["sizes_shown"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(ORACLES["sizes_shown"]).fetchall())
    assert {s.split()[1] for _, s in got} == {"KB", "MB", "GB", "TB"}
