"""Every query that SQL can express against its SQL, on the smallest driver tables."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from quire.plans import library

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float | Decimal) else v


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    df, want = library.queries()[name](spark, DIR), sql.sql(library.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(str(tuple(plain(v) for v in r)) for r in df.select(*want.columns).collect())
    assert got == sorted(str(tuple(plain(v) for v in r)) for r in want.fetchall())


def test_clusters_of_keys_of_seven_digits(spark, tmp_path):
    """Ids are cut to six digits there: L100000 is of 100000 and of 1000000 to 1000009, which come last."""
    parts = [(k, name) for name, keys in (("Red Bolt", (1000009, 5, 999999, 100001, 1000000)), ("old nut", (1000001, 200000)), ("ring", (7,))) for k in keys]
    spark.createDataFrame(parts, "p_partkey long, p_name string").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    want = duckdb.sql(library.oracle_sql()["canonical_clusters"].replace("FROM part", f"FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")).fetchall()
    df = library.queries()["canonical_clusters"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert ("L000005", "red bolt", "L000005,L100001,L999999,L100000,L100000", 5) in want
