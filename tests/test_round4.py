"""What the findings of round 4 named: cases that the code before them failed."""

from __future__ import annotations

import re

import pytest
from pyspark.errors import PySparkException

from ledgerloom import schema, storage
from ledgerloom.operators.coverage import Range
from ledgerloom.plans.query import Ledger
from ledgerloom.storage import BucketTable
from ledgerloom.streaming.live import LedgerStore


def test_different_values_are_folded_once(spark):
    """the fold over a group's different values was made anew for each of some fifty places that it stood at; integers went through all limbs."""
    wide, top = [n.to_bytes(32, "big") for n in (2**255 - 1, 2**64, 7)], (2**256 - 1).to_bytes(32, "big")
    rows = [("a", wide[0], 5), ("a", wide[0], 5), ("a", wide[1], 2**63 - 1), ("b", wide[2], 0), ("b", None, None), ("c", None, None)]
    own = Ledger(spark, {"logs": spark.createDataFrame(rows, "g string, v binary, n long"), "transactions": spark.createDataFrame([(top, -1), (wide[2], 1)], "v binary, n long")})
    df = own.query("SELECT g, u256_to_dec(u256_sum(DISTINCT v)) AS v, u256_to_dec(u256_sum(DISTINCT n)) AS n, u256_to_dec(u256_sum(n)) AS s, u256_to_dec(u256_sum(DISTINCT v) FILTER (WHERE n > 5)) AS f FROM logs GROUP BY g ORDER BY g")
    assert [tuple(r) for r in df.collect()] == [("a", str(2**255 - 1 + 2**64), str(2**63 + 4), str(2**63 + 9), str(2**64)), ("b", "7", "0", "0", None), ("c", None, None, None, None)]
    once = own.query("SELECT g, u256_sum(DISTINCT v) AS v, u256_sum(n) AS n FROM logs GROUP BY g")._jdf.queryExecution().optimizedPlan().toString()
    assert once.count("zip_with(") == 1 and set(re.findall(r"lpad\(hex\(n#\d+L\), 66, 0\), (\d+)", once)) == {"61", "55", "49"}
    for bad in ("u256_sum(DISTINCT v)", "u256_sum(DISTINCT n)", "u256_sum(n)"):
        with pytest.raises(PySparkException):
            own.query(f"SELECT {bad} AS x FROM transactions").collect()


def filled(spark, name, rows):
    """Rows of a table that have some of its columns."""
    empty = {f.name: None for f in schema.TABLES[name]}
    return spark.createDataFrame([tuple({**empty, **r}.values()) for r in rows], schema.TABLES[name])


def test_rows_that_come_again_are_not_shuffled_whole(spark, tmp_path, monkeypatch):
    """rows of new blocks went through a shuffle and a sort whole as soon as one row of the batch was there."""
    store, r, added, was = LedgerStore(spark, str(tmp_path / "store")), Range(0, 9999), [], BucketTable.append
    monkeypatch.setattr(BucketTable, "append", lambda t, state, rows, *a: added.append(rows._jdf.queryExecution().executedPlan().toString()) or was(t, state, rows, *a))
    logs = lambda *keys: filled(spark, "logs", [{"block_number": b, "log_index": i, "data": d} for b, i, d in keys])
    seen = lambda: sorted((x.block_number, x.log_index, bytes(x.data)) for x in store.table("logs").collect())
    first = [(b, i, b"1") for b in (1, 2, 2500) for i in (0, 1, 40_000)]
    store.append("logs", logs(*first), r, reread=True)
    again = [(b, i, b"2") for b in (1, 2, 2500, 2501, 3700) for i in (0, 1, 40_000)]
    store.append("logs", logs(*again), r, reread=True)
    new = [x for x in again if x[0] > 2500]
    assert seen() == sorted(first + new) and len(added) == 2
    for plan in added:
        assert "first(data" not in plan  # what dropDuplicates() makes
    store.append("logs", logs(*again, *again), r, reread=True)
    assert seen() == sorted(first + new) and len(added) == 2  # nothing new
    mixed = [(2, 1, b"3"), (2, 2, b"3"), (2, 40_001, b"3"), (4, 7, b"3"), (4, 7, b"3"), (5, -1, b"3"), (5, 2**40, b"3")]
    store.append("logs", logs(*mixed), r, reread=True)
    assert seen() == sorted({*first, *new, *mixed} - {(2, 1, b"3")})


def test_transactions_that_come_again_in_other_blocks(spark, tmp_path):
    """a hash that is in two blocks, of the batch or of the store, is taken once, the stored one first."""
    store, r = LedgerStore(spark, str(tmp_path / "store")), Range(0, 9999)
    for given, want in (([(1, 1), (2, 2)], {(1, 1), (2, 2)}), ([(3, 1), (3, 3)], {(1, 1), (2, 2), (3, 3)}), ([(1, 1), (5, 5)], {(1, 1), (2, 2), (3, 3), (5, 5)}), ([(1, 1), (1, 6), (7, 7)], {(1, 1), (2, 2), (3, 3), (5, 5), (1, 6), (7, 7)})):
        store.append("transactions", filled(spark, "transactions", [{"block_number": b, "tx_hash": bytes([h]) * 32} for b, h in given]), r, reread=True)
        assert {(x.block_number, x.tx_hash[0]) for x in store.table("transactions").collect()} == want
    store.append("transactions", filled(spark, "transactions", [{"block_number": b, "tx_hash": b"x"} for b in (8, 9)]), r, reread=True)
    assert store.table("transactions").where("block_number > 7").count() == 1


def test_buckets_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """rows were sorted by bucket before they were written, which spilled whole files; more buckets than files that may be open still work."""
    was, store = spark.conf.get(storage.WRITERS), LedgerStore(spark, str(tmp_path / "store"))
    table = store._table("blocks")
    rows = filled(spark, "blocks", [{"block_number": b} for b in range(0, 9000, 300)]).coalesce(1)
    conf, during = type(spark.conf), []
    sets = conf.set
    monkeypatch.setattr(conf, "set", lambda self, k, v: during.append((k, str(v))) or sets(self, k, v))
    table.append({}, rows, 1, (0, 9000))
    assert during == [(storage.WRITERS, str(storage.OPEN_FILES)), (storage.WRITERS, was)]
    assert sorted(x.block_number for x in store.table("blocks").collect()) == list(range(0, 9000, 300))
