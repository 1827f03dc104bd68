"""The price of a time against brute force."""

from __future__ import annotations

import random

import pytest

from ledgerloom.operators import prices
from ledgerloom.operators.prices import with_price


@pytest.mark.parametrize("bucket", [1, 10, 100_000])
def test_with_price(spark, monkeypatch, bucket):
    monkeypatch.setattr(prices, "GROUP", 4)
    rng = random.Random(bucket)
    known = [(rng.randrange(-50, 400), float(rng.randrange(1, 90))) for _ in range(25)] + [(70, 1.5), (70, 9.5), (None, 3.0), (80, None)]
    rows = [(i, rng.choice((None, rng.randrange(-120, 600), 70, 69, 0)), "x") for i in range(200)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "i int, `when` long, `a.b` string")
    got = with_price(df, spark.createDataFrame(known, "time long, price double"), "when", "usd", bucket)
    assert got.columns == ["i", "when", "a.b", "usd"]

    def price(t):
        held = [(x, p) for x, p in known if x is not None and p is not None and t is not None and x <= t]
        return max(held)[1] if held else None

    assert sorted((r[0], r[3] or 0) for r in got.collect()) == sorted((i, price(t) or 0) for i, t, _ in rows)


def test_without_prices_or_rows(spark):
    df = spark.createDataFrame([(5,)], "timestamp long")
    none = spark.createDataFrame([], "time long, price double")
    assert [tuple(r) for r in with_price(df, none).collect()] == [(5, None)]
    assert with_price(df.limit(0), none).collect() == []
