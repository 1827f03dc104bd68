"""The bucketed store: versions that change at once, several chains, gaps, files that may go, progress."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom import queries, schema, storage, views
from ledgerloom.operators import events as ev
from ledgerloom.operators.coverage import Range
from ledgerloom.streaming.live import LedgerStore, fill_gaps, follow, index_blocks, prune_exports

TOPIC = "ab" * 32
TABLE = ev.EventTable("x", TOPIC, (ev.EventColumn("a", "topic1", "uint256"),))
SPAN = Range(0, 10_000)


def exports(spark, numbers, chain: int = 1) -> views.Exports:
    """A transaction and two logs, one of them of TABLE's event, in each block."""
    b = spark.createDataFrame([(n,) for n in numbers], "block_number long").coalesce(1)
    x = lambda what: F.concat(F.lit("0x"), F.sha2(F.concat(F.lit(f"{what}{chain}"), F.col("block_number").cast("string")).cast("binary"), 256))
    address = F.substring(x("a"), 1, 42)
    tx = b.select("block_number", F.lit(0).cast("long").alias("transaction_index"), x("t").alias("transaction_hash"), F.lit(1).cast("long").alias("nonce"), address.alias("from_address"), address.alias("to_address"), F.lit("5").alias("value_string"), F.lit("0x").alias("input"), F.lit(9).cast("long").alias("gas_limit"), F.lit(7).cast("long").alias("gas_used"), F.lit("3").alias("gas_price"), F.lit("2").alias("transaction_type"), F.lit("1").alias("max_priority_fee_per_gas"), F.lit("1").alias("max_fee_per_gas"), F.lit(True).alias("success"))
    two = b.withColumn("log_index", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    logs = two.select("block_number", F.lit(0).cast("long").alias("transaction_index"), "log_index", address.alias("address"), F.when(F.col("log_index") == 0, F.lit(f"0x{TOPIC}")).otherwise(F.lit("0x" + "cd" * 32)).alias("topic0"), x("p").alias("topic1"), F.lit(None).cast("string").alias("topic2"), F.lit(None).cast("string").alias("topic3"), F.lit("0x").alias("data"))
    blocks = b.select(x("b").alias("block_hash"), address.alias("author"), "block_number", F.lit(7).cast("long").alias("gas_used"), F.col("block_number").alias("timestamp"), F.lit("1").alias("base_fee_per_gas"))
    return views.Exports(tx, logs, blocks)


def none(spark):
    return spark.createDataFrame([], "hash binary, signature string")


def filled(spark, root, numbers, chain: int = 1, name: str = "e") -> LedgerStore:
    e = exports(spark, numbers, chain)
    queries.write_exports(spark, e, f"{root}/{name}", 500)
    store = LedgerStore(spark, f"{root}/store", chain)
    index_blocks(store, f"{root}/{name}", e.blocks, none(spark), none(spark), [TABLE])
    return store


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A store of NUMBERS, to be copied."""
    return Path(filled(spark, tmp_path_factory.mktemp("base"), NUMBERS).root)


def copied(spark, base: Path, to: Path) -> LedgerStore:
    shutil.copytree(base, to)
    return LedgerStore(spark, str(to))


def state(store: LedgerStore) -> dict[str, set[int]]:
    """The blocks of each table."""
    tables = {n: store.table(n) for n in schema.TABLES} | {"x": store.events.table("x", store.chain)}
    return {n: {r.block_number for r in t.select("block_number").collect()} for n, t in tables.items()}


def files(folder: Path) -> set[str]:
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def payments(spark, store: LedgerStore, where: str = "true"):
    """A payment for some transactions, that doesn't depend on the store's files any more."""
    rows = store.table("transactions").where(where).select("tx_hash").collect()
    return spark.createDataFrame([(r.tx_hash, b"\x07".rjust(32, b"\0")) for r in rows], "tx_hash binary, payment binary")


NUMBERS = [*range(990, 1000, 3), *range(1000, 1010), 2400, 2500, 2600, 3100]


def test_purge_rewrites_one_bucket(spark, tmp_path):
    store = filled(spark, tmp_path, NUMBERS)
    before = files(tmp_path / "store")
    assert store.purge(keep=600) == 2501
    kept = {n for n in NUMBERS if n >= 2501}
    assert all(v == kept for v in state(store).values())
    assert all(r.n == 2 for r in store.table("logs").groupBy("block_number").agg(F.count("*").alias("n")).collect())
    now = files(tmp_path / "store")
    assert {f for f in now if "bucket=3" in f} == {f for f in before if "bucket=3" in f}
    assert not [f for f in now if "bucket=0" in f or "bucket=1" in f]
    assert len({f.rsplit("/", 1)[0] for f in now if "bucket=2" in f}) == 4 and not {f for f in now if "bucket=2" in f} & before
    # rows that come again go into the generation that counts; older blocks may be indexed again
    e = exports(spark, [2500, 2600])
    index_blocks(store, f"{tmp_path}/e", e.blocks, none(spark), none(spark), [TABLE])
    assert all(v == kept | {2500} for v in state(store).values())
    assert store.purge(keep=10_000) == 0 and LedgerStore(spark, f"{tmp_path}/none").purge(5) is None


def stopped(monkeypatch, at: int):
    """Every change of the store counts as a step; the one with this number is begun and not ended."""
    steps = [0]

    def stop(f, after):
        def g(*args, **kw):
            steps[0] += 1
            if steps[0] == at and not after:
                raise KeyboardInterrupt
            out = f(*args, **kw)
            if steps[0] == at:
                raise KeyboardInterrupt
            return out

        return g

    for kind, name in ((storage.Versions, "commit"), (storage.BucketTable, "write"), (storage.BucketTable, "sweep")):
        monkeypatch.setattr(kind, name, stop(getattr(kind, name), at % 2 == 0))
    return steps


def test_purge_stopped_anywhere(spark, base, tmp_path, monkeypatch):
    """After each step, and within it, a reader finds all rows or the kept ones; the next purge ends the work."""
    kept = {n for n in NUMBERS if n >= 2501}
    for at in (1, 4, 5, 6, 9, 10):
        store = copied(spark, base, tmp_path / f"s{at}")
        with monkeypatch.context() as m:
            stopped(m, at)
            with pytest.raises(KeyboardInterrupt):
                store.purge(keep=600)
        seen = state(LedgerStore(spark, store.root))
        assert all(v == set(NUMBERS) for v in seen.values()) or all(v == kept for v in seen.values())
        again = LedgerStore(spark, store.root)
        again.purge(keep=600)
        assert all(v == kept for v in state(again).values()) and not again.versions.read()[1].get("floor")
        assert not [f for f in files(Path(store.root)) if "bucket=0" in f or "bucket=1" in f]


def test_rebuild_stopped_anywhere(spark, base, tmp_path, monkeypatch):
    other = ev.EventTable("x", TOPIC, (ev.EventColumn("a", "topic1", "address"), ev.EventColumn("b", "topic1", "uint256")))
    for at in range(1, 4):
        store = copied(spark, base, tmp_path / f"s{at}")
        with monkeypatch.context() as m:
            stopped(m, at)
            with pytest.raises(KeyboardInterrupt):
                store.rebuild_events([other])
        t = LedgerStore(spark, store.root).events.table("x")
        assert t.columns in ([*ev.IMPLICIT, "a"], [*ev.IMPLICIT, "a", "b"]) and t.count() == len(NUMBERS)
        store.rebuild_events([other])
        t = store.events.table("x")
        assert t.columns == [*ev.IMPLICIT, "a", "b"] and t.count() == len(NUMBERS)
    with pytest.raises(ValueError):
        store.events.sync(TABLE, store.table("logs"))
    store.rebuild_events([])
    assert store.events.tracked() == {} and not (Path(store.root) / "events/x").exists()


def test_foreign_folder(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x")
    store = ev.EventStore(spark, str(tmp_path))
    logs = spark.createDataFrame([], schema.LOGS)
    with pytest.raises(ValueError):
        store.sync(TABLE, logs)
    store.rebuild([TABLE], logs)
    assert store.table("x").count() == 0 and store.sync(TABLE, logs) == "unchanged"


def test_two_writers(spark, tmp_path):
    v = storage.Versions(spark, str(tmp_path))
    for n in range(1, 7):
        v.commit(n, {"n": n})
    assert v.read() == (6, {"n": 6}) and len(list((tmp_path / "_versions").glob("0*.json"))) == v.KEEP
    with pytest.raises(RuntimeError):
        v.commit(6, {"n": 7})
    assert v.read() == (6, {"n": 6})


def test_backfill(spark, base, tmp_path):
    store = copied(spark, base, tmp_path / "store")
    pay = payments(spark, store, "block_number IN (2400, 2600, 990)")
    before = files(tmp_path / "store")
    assert store.backfill(pay, Range(2000, 2999)) == [2]
    now = files(tmp_path / "store")
    assert {f for f in before ^ now} == {f for f in before | now if f.startswith("transactions/") and "bucket=2/" in f}
    got = {r.block_number: r.coinbase_transfer for r in store.table("transactions").collect()}
    assert {n for n, v in got.items() if v is not None} == {2400, 2600} and set(got) == set(NUMBERS)
    assert store.backfill(pay, Range(2000, 2999)) == [] and store.backfill(pay, SPAN) == [0]


def test_backfill_stopped(spark, base, tmp_path, monkeypatch):
    store = copied(spark, base, tmp_path / "store")
    pay = payments(spark, store)
    for at in (1, 2, 3):
        with monkeypatch.context() as m:
            stopped(m, at)
            try:
                store.backfill(pay, SPAN)
            except KeyboardInterrupt:
                pass
        values = [r.coinbase_transfer for r in LedgerStore(spark, store.root).table("transactions").collect()]
        assert len(values) == len(NUMBERS) and len({v is None for v in values}) == 1
    store.backfill(pay, SPAN)
    assert store.table("transactions").where("coinbase_transfer IS NULL").isEmpty()


def test_two_chains(spark, tmp_path):
    """Files of two networks in one folder, with the same block numbers; a table that one chain has."""
    for chain, name in ((1, "ethereum"), (10, "optimism")):
        e = exports(spark, range(1200, 1210 + chain), chain)
        queries.write_exports(spark, e, f"{tmp_path}/e", 500, name)
    only = ev.EventTable("y", TOPIC, TABLE.columns, chains=(10,))
    store = LedgerStore(spark, f"{tmp_path}/store")
    follow(store, f"{tmp_path}/e", f"{tmp_path}/c", none(spark), none(spark), [TABLE, only], networks={"ethereum": 1, "optimism": 10}).awaitTermination()
    assert store.table("blocks").count() == 11 and store.on(10).table("blocks").count() == 20
    assert store.events.table("x").count() == 31 and store.events.table("y").count() == 20 and store.events.table("x", 1).count() == 11
    declared = ev.declarations(spark, [TABLE, only], [1, 10])
    met = ev.declared_logs(store.all_chains("logs"), declared.where("event_table = 'y'"))
    assert met.count() == 20 and {r.chain_id for r in met.select("chain_id").distinct().collect()} == {10}
    assert "dynamicpruning" in met._jdf.queryExecution().executedPlan().toString().lower()
    assert store.on(10).purge(5) == 1215 and store.table("blocks").count() == 11 and store.on(10).table("blocks").count() == 5
    assert sorted(r.chain_id for r in store.progress().collect()) == [1, 10]


def test_gaps_are_filled_and_files_pruned(spark, tmp_path):
    every = list(range(1000, 3000, 50))
    e = exports(spark, every)
    queries.write_exports(spark, e, f"{tmp_path}/e", 500)
    store = LedgerStore(spark, f"{tmp_path}/store")
    there = [n for n in every if n < 1200 or n > 2700]
    index_blocks(store, f"{tmp_path}/e", e.blocks.where(F.col("block_number").isin(there)), none(spark), none(spark), [TABLE])
    done = fill_gaps(store, f"{tmp_path}/e", none(spark), none(spark), [TABLE])
    assert done == (1200, 2700, len(every) - len(there), 0)
    assert all(v == set(every) for v in state(store).values())
    assert fill_gaps(store, f"{tmp_path}/e", none(spark), none(spark), [TABLE], keep=60) is None
    assert prune_exports(store, f"{tmp_path}/e", SPAN) == []  # no file has a stored block at each of its numbers
    whole = exports(spark, range(5000, 5500))
    queries.write_exports(spark, whole, f"{tmp_path}/e", 500)
    index_blocks(store, f"{tmp_path}/e", whole.blocks, none(spark), none(spark), [TABLE])
    assert [Path(p).name for p in prune_exports(store, f"{tmp_path}/e", SPAN)] == [f"ethereum__{d}__00005000_to_00005499.parquet" for d in ("blocks", "logs", "transactions")]
    assert not list((tmp_path / "e").glob("*5000*")) and len(list((tmp_path / "e").glob("*.parquet"))) == 12
    assert LedgerStore(spark, f"{tmp_path}/none").table("blocks").isEmpty()


def test_progress_of_a_repeated_batch(spark, tmp_path):
    e = exports(spark, range(1000, 1040))
    queries.write_exports(spark, e, f"{tmp_path}/e", 500)
    for n in range(2):  # a new checkpoint begins with batch 0 again
        store = LedgerStore(spark, f"{tmp_path}/store")
        follow(store, f"{tmp_path}/e", f"{tmp_path}/c{n}", none(spark), none(spark), [TABLE]).awaitTermination()
    assert [tuple(r) for r in store.progress().collect()] == [(1, 1000, 1039, 40, 0, 0)]
