"""What the findings of round 3 named: cases that the code before them failed."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom import queries, schema, views
from ledgerloom.operators import ingest, traces
from ledgerloom.operators.coverage import Range
from ledgerloom.streaming import live
from ledgerloom.streaming.live import LedgerStore


@pytest.mark.parametrize("name", ["i9_store_stats", "i9_store_stats_sql"])
@pytest.mark.parametrize(("n", "size"), [(0, "0.00 KB"), (5, "0.49 KB"), (11_000_000, "1049.04 MB")])
def test_size_of_a_store_is_in_kb_or_mb(spark, monkeypatch, name, n, size):
    logs = spark.range(n).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.LOGS])
    t = views.tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(views, "tables", lambda *_: t._replace(logs=logs))
    assert queries.QUERIES[name](spark, "").first()["db_size"] == size


def test_log_parsing_and_texts_stay_compiled(spark):
    """Methods over 8,000 bytes would run uncompiled, lambdas are interpreted; a text is made once for its parts."""
    was = spark.conf.get(views.HUGE_METHOD)
    try:
        spark.conf.set(views.HUGE_METHOD, 65535)
        plan = queries.QUERIES["a2_logs_export"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert int(spark.conf.get(views.HUGE_METHOD)) <= 8000
        assert "lambdafunction" not in plan and "filter(array" not in plan
    finally:
        spark.conf.set(views.HUGE_METHOD, was)


def test_bytes_from_hex_of_odd_or_bad_text(spark):
    df = spark.createDataFrame([("0xAb01",), ("ab01",), ("0x",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(F.hex(ingest.to_bytes("x"))).collect()] == ["AB01", "AB01", "", "", ""]
    for bad in ("0xabc", "abc", "0xzz", "zz"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "x string").select(ingest.to_bytes("x")).collect()


def test_append_of_rows_that_may_be_read_twice(spark, tmp_path):
    """New and different rows, repeated ones, known ones, and some of each; files come from rows that meet by their part already."""
    store, r = LedgerStore(spark, str(tmp_path / "store")), Range(0, 9)
    block = lambda *ns: spark.createDataFrame([(n, b"h", b"m", 1, n, None) for n in ns], schema.BLOCKS)
    for given, want in ((block(1, 1, 2), [1, 2]), (block(1, 2, 2), [1, 2]), (block(2, 3, 3), [1, 2, 3])):
        store.append("blocks", given, r, reread=True)
        assert sorted(x.block_number for x in store.table("blocks").collect()) == want
    assert "k" in views.exports(spark, "/root/testdata/sf0.001", 250).logs.columns


def counted(df, n):
    """The rows, each of which adds one to an accumulator whenever it is computed."""

    def work(batches):
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    return df.mapInArrow(work, df.schema)


def hashes(*ns: int) -> list[bytes]:
    return [bytes([n]) * 32 for n in ns]


def test_payments_take_calls_once(spark):
    """calls were computed for the traced transactions and again for the payments."""
    miner, other, wei = b"m" * 20, b"o" * 20, [n.to_bytes(32, "big") for n in range(9)]
    one, two, three, four, five = hashes(1, 2, 3, 4, 5)
    rows = [(one, 3, miner, wei[3]), (one, 1, miner, None), (one, 2, miner, wei[2]), (one, 0, other, wei[8]), (two, 0, None, wei[1]), (two, 1, other, None), (three, 0, miner, wei[5]), (four, 0, miner, None), (hashes(9)[0], 0, miner, wei[4])]
    calls = spark.createDataFrame([(h, s, None, to, v, None) for h, s, to, v in rows], traces.CALLS)
    transactions = spark.createDataFrame([(one, 1), (two, 1), (three, 2), (four, 1), (five, 1)], "tx_hash binary, block_number long")
    blocks = spark.createDataFrame([(1, miner), (2, None)], "block_number long, miner binary")
    n = spark.sparkContext.accumulator(0)
    got = {bytes(r.tx_hash): bytes(r.payment) for r in traces.direct_payments(counted(calls, n), transactions, blocks).collect()}
    assert got == {one: wei[2], two: wei[0], four: wei[0]}  # block 2 has no miner, five isn't traced
    assert n.value == len(rows)


def test_backfill_computes_payments_once_and_shuffles_what_it_fills(spark, tmp_path, monkeypatch):
    """payments were computed for the buckets and again for the rows; whole buckets were joined with them."""
    store, r, wei = LedgerStore(spark, str(tmp_path / "store")), Range(0, 2999), [n.to_bytes(32, "big") for n in range(9)]
    stored = {n: (block, wei[7] if n % 2 else None) for n, block in zip(range(1, 11), (5, 6, 7, 8, 9, 1500, 1501, 2500, 2501, 2999), strict=True)}
    empty = {f.name: None for f in schema.TRANSACTIONS}
    rows = spark.createDataFrame([tuple({**empty, "block_number": b, "tx_hash": hashes(n)[0], "coinbase_transfer": c}.values()) for n, (b, c) in stored.items()], schema.TRANSACTIONS)
    store.append("transactions", rows, r)
    pay = spark.createDataFrame([(hashes(n)[0], w) for n, w in ((1, wei[1]), (2, wei[2]), (4, None), (8, wei[3]), (10, wei[4]), (99, wei[5]))], "tx_hash binary, payment binary")
    n, joined, was = spark.sparkContext.accumulator(0), [], traces.backfill
    monkeypatch.setattr(live, "FILL_ROWS", 2)  # three tasks
    monkeypatch.setattr(traces, "backfill", lambda tx, p: joined.append(tx.count()) or was(tx, p))
    assert store.backfill(counted(pay, n), Range(0, 2600)) == [0, 2]  # the last one is of a bucket in range, but itself isn't
    assert n.value == 6 and joined == [5 - 1]  # those without a value, of buckets 0 and 2
    want = {**{k: c for k, (_, c) in stored.items()}, 2: wei[2], 8: wei[3]}
    assert {x.tx_hash[0]: x.coinbase_transfer and bytes(x.coinbase_transfer) for x in store.table("transactions").collect()} == want
    assert store.backfill(pay, Range(0, 2600)) == []
