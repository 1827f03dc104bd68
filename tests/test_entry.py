"""All ledger queries against their SQL in DuckDB, over the smallest given tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from ledgerloom import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("the given tables aren't here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    as_text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert as_text(got.select(*columns).collect()) == as_text(want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
