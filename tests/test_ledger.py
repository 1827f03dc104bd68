"""Golden values and awkward cases of the ledger library."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions import keccak
from ledgerloom.functions import u256 as u
from ledgerloom.functions.display import byte_size, convert_usd, format_usd, gwei_of_long
from ledgerloom.operators import coverage, ingest, signatures, traces
from ledgerloom.operators import events as ev
from ledgerloom.operators.coverage import Range, parse_range
from ledgerloom.plans import display
from ledgerloom.plans.query import Ledger, QueryError
from ledgerloom.sources import exports, sinks


def wide(n: int | None) -> bytes | None:
    return None if n is None else n.to_bytes(32, "big")


EDGES = [0, 1, 2**32 - 1, 2**32, 2**64, 2**128, 2**255, 2**256 - 1]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    values = EDGES + [rng.getrandbits(rng.randint(1, 256)) for _ in range(60)] + [None]
    return values, spark.createDataFrame([(i, wide(v)) for i, v in enumerate(values)], "i long, x binary")


def test_sum_and_add_match_whole_numbers(spark, numbers):
    values, df = numbers
    small = df.where(F.col("i") >= len(EDGES)).withColumn("x", F.when(F.col("i") % 7 != 0, F.expr("lpad(substring(x, 5, 28), 32, X'00')")))
    got = small.groupBy((F.col("i") % 5).alias("g")).agg(u.u256_sum("x").alias("s")).collect()
    for r in got:
        own = [v % 2**224 for i, v in enumerate(values) if i >= len(EDGES) and i % 5 == r.g and i % 7 and v is not None]
        assert int.from_bytes(r.s, "big") == sum(own)
    assert df.where("i < 0").agg(u.u256_sum("x").alias("s")).first().s is None
    assert df.where("x is null").agg(u.u256_sum("x").alias("s")).first().s is None
    pairs = spark.createDataFrame([(wide(a), wide(b)) for a in EDGES for b in EDGES if a + b < 2**256], "a binary, b binary")
    assert [int.from_bytes(r[0], "big") for r in pairs.select(u.u256_add("a", "b")).collect()] == [a + b for a in EDGES for b in EDGES if a + b < 2**256]
    short = spark.createDataFrame([(b"\x01", b"\xff\xff")], "a binary, b binary")
    assert int.from_bytes(short.select(u.u256_add("a", "b")).first()[0], "big") == 65536


def test_overflow_raises(spark):
    top = spark.createDataFrame([(wide(2**256 - 1), wide(1))], "a binary, b binary")
    for c in (u.u256_add("a", "b"), u.u256_mul("a", F.lit(2)), u.from_long(F.lit(-1))):
        with pytest.raises(PySparkException):
            top.select(c).collect()
    with pytest.raises(PySparkException):
        top.select(F.explode(F.array("a", "b")).alias("x")).agg(u.u256_sum("x")).collect()
    with pytest.raises(PySparkException):
        top.select(u.erc20_to_real("a", 78)).collect()


def test_text_of_bytes_is_exact(spark, numbers):
    """By built-ins for any width, on both sides of 2^126, with roundings that carry."""
    values, _ = numbers
    values = values + [2**126 - 1, 2**126, 10**38 - 1, 10**38, 999_999_500_000_000_000, 999_999_499_999_999_999, 10**77 - 1, 10**60 - 500_000_000_000, 10**60 - 500_000_000_001, 2**256 - 3 * 10**11, 5 * 10**6, 5 * 10**6 - 1, 10**40 - 5 * 10**6]
    df = spark.createDataFrame([(i, wide(v)) for i, v in enumerate(values)] + [(-1, b"\xff"), (-2, b"")], "i long, x binary")
    got = {r.i: r for r in df.select("i", u.u256_to_dec("x").alias("d"), u.format_ether("x").alias("e"), u.format_gwei("x").alias("g")).collect()}
    for i, v in [*enumerate(values), (-1, 255), (-2, 0)]:
        assert (got[i].d, got[i].e, got[i].g) == (None if v is None else str(v), u._fixed(v, 18, 6, "ETH"), u._fixed(v, 9, 2, "gwei"))
    assert "Python" not in df.select(u.u256_to_dec("x"), u.format_ether("x"))._jdf.queryExecution().executedPlan().toString()


def test_sum_of_products(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(rng.randint(1, 63)), rng.getrandbits(rng.randint(1, 63))) for _ in range(300)] + [(2**63 - 1, 2**63 - 1)] * 3 + [(0, 5), (None, 3), (3, None)]
    df = spark.createDataFrame([(i % 4, a, b) for i, (a, b) in enumerate(pairs)], "g int, a long, b long")
    for r in df.groupBy("g").agg(u.sum_of_products("a", "b").alias("s")).collect():
        assert int.from_bytes(r.s, "big") == sum(a * b for i, (a, b) in enumerate(pairs) if i % 4 == r.g and a is not None and b is not None)
    assert df.where("a IS NULL").agg(u.sum_of_products("a", "b").alias("s")).first().s is None
    with pytest.raises(PySparkException):
        df.select(F.lit(-1).cast("long").alias("a"), "b").agg(u.sum_of_products("a", "b").alias("s")).collect()


def test_products_and_text(spark, numbers):
    values, df = numbers
    assert [r[0] for r in df.orderBy("i").select(u.u256_to_dec("x")).collect()] == [None if v is None else str(v) for v in values]
    rng = random.Random(2)
    longs = [0, 1, 2**31, 2**32 - 1, 2**62, 2**63 - 1] + [rng.getrandbits(63) for _ in range(20)]
    df2 = spark.createDataFrame([(a, b) for a in longs for b in longs], "a long, b long")
    assert [int.from_bytes(r[0], "big") for r in df2.select(u.mul_longs("a", "b")).collect()] == [a * b for a in longs for b in longs]
    texts = ["0", "1", "9" * 38, "340282366920938463463374607431768211455", "00012", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(u.from_dec("t"), u.wide_from_dec("t")).collect()
    assert [(None if r[0] is None else int.from_bytes(r[0], "big")) for r in got] == [None if t is None else int(t) for t in texts]
    assert [r[0] for r in got] == [r[1] for r in got]
    assert spark.createDataFrame([(str(2**256 - 1),)], "t string").select(u.wide_from_dec("t")).first()[0] == wide(2**256 - 1)
    real = df.select("i", u.to_double("x").alias("d")).orderBy("i").collect()
    assert all(r.d == (None if v is None else pytest.approx(float(v))) for r, v in zip(real, values, strict=True))


def test_display_of_a_known_transaction(spark):
    df = spark.createDataFrame([(63209, 2233334825, wide(0), None)], "g long, p long, v binary, n binary")
    cost = u.mul_longs("g", "p")
    r = df.select(u.u256_to_dec(cost), u.format_ether(cost), gwei_of_long("p"), format_usd(convert_usd(cost, 2500.5)), u.u256_to_dec("v"), u.format_ether("v"), u.format_ether("n"), format_usd(convert_usd("n", 2.0))).first()
    assert list(r) == ["141166860953425", "0.000141 ETH", "2.23 gwei", "$0.35", "0", "0.000000 ETH", None, None]
    usd = spark.range(1).select(format_usd(F.lit(0.005756)), format_usd(F.lit(1234567.891)), format_usd(convert_usd(u.from_long(F.lit(3437206778184)), 1674.61477))).first()
    assert list(usd) == ["$0.01", "$1,234,567.89", "$0.01"]
    sizes = spark.range(1).select(*[byte_size(F.lit(n)) for n in (1023, 2048, 5 << 20, 3 << 30)]).first()
    assert list(sizes) == ["1023 B", "2.00 KB", "5.00 MB", "3.00 GB"]
    assert spark.range(1).select(u.wei_to_eth(F.lit("1500000000000000000"))).first()[0] == 1.5


def test_binary_order_is_numeric_order(spark):
    df = spark.createDataFrame([(wide(2000),), (wide(500),)], "x binary")
    assert [int.from_bytes(r.x, "big") for r in df.orderBy("x").collect()] == [500, 2000]
    assert df.where(F.col("x") > F.lit(wide(1000))).count() == 1


def test_contract_addresses():
    sender = bytes.fromhex("6ac7ea33f8831ea9dcc53393aaa88b25a785dbf0")
    got = keccak.created([sender] * 3 + [None], [0, 1, 2, 3])
    assert [x and x.hex() for x in got] == ["cd234a471b72ba2f1ccf0a70fcaba648a5eecd8d", "343c43a37d37dff08ae8c4a11544c718abb4fcf8", "f778b86fa74e846c4f0a1fbd1335fe81c00a0c91", None]
    assert [keccak.rlp_of(b"\0" * 20, n)[22:].hex() for n in (0, 127, 128, 256)] == ["80", "7f", "8180", "820100"]


def tx(**changes):
    row = dict(zip(schema.TX_EXPORT.fieldNames(), (7, 0, "0x" + "ab" * 32, 1, "0x" + "11" * 20, "0x" + "22" * 20, "5", "0xa9059cbb00", 10, 9, "8", "2", "1", "3", True), strict=True)) | changes
    return tuple(row[c] for c in schema.TX_EXPORT.fieldNames())


def test_ingest_of_transactions(spark):
    rows = [
        tx(), tx(transaction_hash="0x" + "01" * 32, to_address=None), tx(transaction_hash="0x" + "02" * 32, to_address="0x", input="0x6080604052"), tx(transaction_hash="0x" + "03" * 32, input="0x0102"),
        tx(transaction_hash="0x" + "04" * 32, input="0x098999be"), tx(transaction_hash="0x" + "05" * 32, input="0x098999be", transaction_index=1), tx(transaction_hash="0x" + "06" * 32, max_fee_per_gas="zz", max_priority_fee_per_gas=None, transaction_type="q"),
        tx(transaction_hash="0x" + "07" * 32, gas_price="9223372036854775808"),
    ]
    export = spark.createDataFrame(rows, schema.TX_EXPORT)
    methods = spark.createDataFrame([(bytes.fromhex("a9059cbb"), "transfer(address,uint256)")], "hash binary, signature string")
    got = {r.tx_hash[0]: r for r in ingest.transactions(export, methods).collect()}
    assert {k: r.signature for k, r in got.items()} == {0xAB: "transfer(address,uint256)", 1: "CREATE()", 2: "CREATE()", 3: None, 4: "setL1BlockValuesIsthmus()", 5: "?", 6: "transfer(address,uint256)"}
    assert got[1].signature_hash is None and got[1].to_address == keccak.created([b"\x11" * 20], [1])[0] and got[0xAB].success == 1
    assert (got[6].max_fee_per_gas, got[6].max_priority_fee_per_gas, got[6].transaction_type) == (0, 0, None)
    assert ingest.overpriced(export).count() == 1
    assert ingest.new_rows(ingest.transactions(export, methods), ingest.transactions(export, methods), "transactions").count() == 0
    with pytest.raises(PySparkException):
        ingest.transactions(spark.createDataFrame([tx(input="0xabc")], schema.TX_EXPORT), methods).collect()


def test_ingest_of_logs(spark):
    transfer = "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    amount = "0x" + "0" * 56 + "2f9fc5c0"
    rows = [(1, 0, 6, "0x" + "aa" * 20, "0x" + transfer, "0x" + "01" * 32, "0x" + "02" * 32, None, amount), (1, 0, 7, "0x" + "aa" * 20, "0x" + transfer, None, "0x" + "02" * 32, "0x", "0x"), (1, 1, 8, "0x" + "aa" * 20, None, None, None, None, amount)]
    events = spark.createDataFrame([(bytes.fromhex(transfer), ingest.ERC20_TRANSFER)], "hash binary, signature string")
    got = {r.log_index: r for r in ingest.logs(spark.createDataFrame(rows, schema.LOG_EXPORT), events).collect()}
    assert int.from_bytes(got[6].erc20_amount, "big") == 799000000 and got[6].topic3 is None
    assert got[7].erc20_amount is None and got[7].topic1 == b"\x02" * 32 and got[7].topic2 is None
    assert got[8].signature is None and got[8].erc20_amount is None and got[8].topic0 is None


def test_signature_dictionary(spark):
    named = spark.createDataFrame([(b"1234", b"a" * 32, "f(b)"), (b"1234", b"a" * 32, "f(a)"), (b"5678", b"b" * 32, "E()"), (b"9999", b"c" * 32, "none()"), (b"0000", b"d" * 32, None)], "signature_hash_4 binary, signature_hash_32 binary, signature string")
    kinds = spark.createDataFrame([(b"a" * 32, "function"), (b"b" * 32, "event"), (b"b" * 32, "function"), (b"c" * 32, "error"), (b"x", "event"), (None, "event")], "signature_hash_32 binary, signature_type string")
    methods, events, skipped = signatures.dictionary(named, kinds)
    assert sorted(r.signature for r in methods.collect()) == ["E()", "f(a)", "f(b)"]
    assert [r.signature for r in events.collect()] == ["E()"] and [r.signature for r in skipped.collect()] == ["none()"]
    assert {bytes(r.hash): r.signature for r in signatures.one_text(methods).collect()} == {b"1234": "f(a)", b"5678": "E()"}


def blocks_of(spark, numbers):
    return spark.createDataFrame([(n, b"h", b"m", 1, n * 12, None) for n in numbers], schema.BLOCKS)


def test_coverage(spark):
    b = blocks_of(spark, [101, 103])
    assert sorted(r[0] for r in coverage.missing_blocks(b, Range(100, 104)).collect()) == [100, 102, 104]
    files = exports.files_of(spark.createDataFrame([("x/ethereum__logs__00000100_to_00000110.parquet",), ("x/ethereum__logs__00000120_to_00000130.parquet",), ("x/other.parquet",)], "path string"))
    assert files.count() == 2
    assert [tuple(r) for r in coverage.uncovered(files, Range(100, 130)).collect()] == [(111, 119)]
    assert sorted(tuple(r) for r in coverage.uncovered(files, Range(90, 140)).collect()) == [(90, 99), (111, 119), (131, 140)]
    assert [tuple(r) for r in coverage.uncovered(files.limit(0), Range(5, 6)).collect()] == [(5, 6)]
    assert exports.overlapping(files, 111, 119).count() == 0 and exports.overlapping(files, 110, 120).count() == 2
    runs = coverage.contiguous_runs(blocks_of(spark, [1, 2, 3, 7, 8, 9, 10, 20, 64, 65]), bucket=4)
    assert sorted(tuple(r) for r in runs.collect()) == [(1, 3), (7, 10), (20, 20), (64, 65)]
    assert [r.path for r in coverage.prunable(files, blocks_of(spark, range(100, 120)), Range(100, 130)).collect()] == ["x/ethereum__logs__00000100_to_00000110.parquet"]
    assert sorted(tuple(r) for r in coverage.gap_fill(blocks_of(spark, [1, 5, 9]), keep=6).collect()) == [(4, 4), (6, 8)]
    assert coverage.gap_fill(blocks_of(spark, [])).count() == 0
    assert tuple(coverage.run_summary(b, Range(100, 104)).first()) == (100, 104, 5, 3, 2)
    stats = coverage.statistics(spark.createDataFrame([], schema.TRANSACTIONS), spark.createDataFrame([], schema.LOGS), blocks_of(spark, [])).first()
    assert stats.total_blocks == 0 and stats.missing_blocks == 0 and stats.min_block is None


@pytest.mark.parametrize(("text", "want"), [("5", (5, 5)), ("3:7", (3, 7)), ("latest", (100, 100)), ("10:latest", (91, 100)), ("10:", (91, 100)), ("500:", (0, 100))])
def test_ranges(text, want):
    assert parse_range(text, 100) == want


@pytest.mark.parametrize("text", ["", "x", "7:3", "50:101", "101", "0:", "5latest", "1:2:3", "-1"])
def test_bad_ranges(text):
    with pytest.raises(ValueError):
        parse_range(text, 100)
    with pytest.raises(ValueError):
        parse_range("1:50", 100, max_size=49)


@pytest.mark.parametrize(("keep", "cut", "left"), [(2, 103, 2), (1000, 0, 5), (0, 105, 0)])
def test_retention(spark, keep, cut, left):
    b = blocks_of(spark, range(100, 105))
    kept, report = coverage.retention({"blocks": b, "logs": b.select("block_number")}, keep)
    assert tuple(report.first()) == (104, cut, 5 - left, 5 - left) and kept["logs"].count() == left
    assert coverage.retention({"blocks": blocks_of(spark, [])}, keep)[1].count() == 0


def log(n, data=b"", topic0=b"t" * 32, address=b"a" * 20, topic1=b"\0" * 12 + b"w" * 20):
    return (n, 0, 0, address, topic0, topic1, None, None, data, None, None)


def test_event_columns(spark):
    table = ev.EventTable("moves", (b"t" * 32).hex(), (ev.EventColumn("who", "topic1", "address"), ev.EventColumn("whole", "topic1", "uint256"), ev.EventColumn("small", "data[0:4]", "uint256"), ev.EventColumn("raw", "data[1:3]", "bytes"), ev.EventColumn("to", "data[4:24]", "address"), ev.EventColumn("late", "data[100:132]", "uint256")))
    logs = spark.createDataFrame([log(1, bytes([1, 2, 3, 4]) + b"z" * 20), log(2, topic0=b"u" * 32)], schema.LOGS)
    r = ev.event_rows(logs, table).collect()
    assert len(r) == 1 and r[0].who == b"w" * 20 and r[0].small == bytes(28) + bytes([1, 2, 3, 4]) and r[0].raw == bytes([2, 3]) and r[0].to == b"z" * 20 and r[0].late == b""


@pytest.mark.parametrize("bad", [("Upper", "topic1", "uint256"), ("address", "topic1", "uint256"), ("a", "topic0", "uint256"), ("a", "data[4:4]", "bytes"), ("a", "data[0:33]", "uint256"), ("a", "data[0:31]", "address"), ("a", "topic1", "bytes"), ("a", "topic1", "text"), ("a", "input[0:4]", "bytes")])
def test_bad_event_columns(bad):
    with pytest.raises(ValueError):
        ev.EventColumn(*bad)


def test_event_tables(spark, tmp_path):
    c1, c2 = ev.EventColumn("a", "topic1", "uint256"), ev.EventColumn("b", "topic2", "uint256")
    for bad in (("logs", "00" * 32, (c1,)), ("x", "00" * 31, (c1,)), ("x", "zz" * 32, (c1,)), ("x", "00" * 32, ()), ("x", "00" * 32, (c1, c1))):
        with pytest.raises(ValueError):
            ev.EventTable(*bad)
    t = lambda *cols, **kw: ev.EventTable("x", (b"t" * 32).hex(), cols, **kw)
    ends = ("11" * 20, "0x" + "22" * 20)
    prints = spark.range(1).select(t(c1, c2, addresses=ends).fingerprint(), t(c1, c2, addresses=ends[::-1], chains=(5,)).fingerprint(), t(c2, c1, addresses=ends).fingerprint()).first()
    assert prints[0] == prints[1] != prints[2]
    assert t(c1).applies_to(3) and t(c1, chains=(1,)).applies_to(1) and not t(c1, chains=(1,)).applies_to(2)
    logs = spark.createDataFrame([log(1), log(2), log(3, topic0=b"u" * 32)], schema.LOGS)
    store = ev.EventStore(spark, f"{tmp_path}/events")
    assert store.sync(t(c1), logs.where("block_number = 1")) == "created" and store.table("x").count() == 1
    assert store.sync(t(c1), logs) == "unchanged"
    store.append(t(c1), logs, Range(1, 2))
    store.append(t(c1), logs, Range(1, 2))
    assert store.table("x").count() == 2
    with pytest.raises(ValueError):
        store.sync(t(c1, c2), logs)
    store.rebuild([t(c1, c2)], logs)
    assert store.table("x").columns == [*ev.IMPLICIT, "a", "b"] and store.table("x").count() == 2


def test_traces(spark):
    tree = {"from": "0x01", "to": "0x02", "value": "0x5", "input": "0x", "calls": [{"from": "0x02", "to": "0x03", "input": "0xa9059cbb", "calls": [{"from": "0x03", "input": "0x"}]}, {"from": "0x02", "to": "0x04", "value": "0x0", "input": "0xdeadbeef"}]}
    calls = traces.flatten(spark.createDataFrame([(b"t", json.dumps(tree)), (b"n", None)], "tx_hash binary, call string")).orderBy("seq").collect()
    assert [(c.seq, c.from_address.hex(), c.to_address and c.to_address.hex(), c.value and int.from_bytes(c.value, "big")) for c in calls] == [(0, "01", "02", 5), (1, "02", "03", None), (2, "03", None, None), (3, "02", "04", 0)]
    df = spark.createDataFrame(calls, traces.CALLS)
    txs = spark.createDataFrame([(b"t", 1, 0), (b"v", 1, 1)], "tx_hash binary, block_number long, tx_index long")
    pay = lambda miner: traces.direct_payments(df, txs, spark.createDataFrame([(1, miner)], "block_number long, miner binary")).collect()
    assert [int.from_bytes(r.payment, "big") for r in pay(b"\x02")] == [5] and [int.from_bytes(r.payment, "big") for r in pay(b"\x04")] == [0] and pay(None) == []
    methods = spark.createDataFrame([(bytes.fromhex("a9059cbb"), "transfer()")], "hash binary, signature string")
    assert [r.signature for r in traces.decoded_calls(df, txs, methods).orderBy("seq").collect()] == ["<ETH transfer>", "transfer()", "?"]
    s = "tx_hash binary, address binary, slot binary, value binary"
    pre = spark.createDataFrame([(b"t", b"a", b"1", wide(0)), (b"t", b"a", b"2", wide(3)), (b"t", b"a", b"3", wide(4)), (b"t", b"c", b"1", wide(4))], s)
    post = spark.createDataFrame([(b"t", b"a", b"1", None), (b"t", b"a", b"2", wide(3)), (b"t", b"a", b"3", wide(0)), (b"t", b"b", b"9", wide(7))], s)
    got = {(bytes(r.address), bytes(r.slot)): (r.before, r.after) for r in traces.storage_diff(pre, post).collect()}
    assert got == {(b"a", b"1"): (None, None), (b"a", b"3"): (wide(4), None), (b"b", b"9"): (None, wide(7)), (b"c", b"1"): (wide(4), None)}
    assert [bytes(x) for x in traces.affected_addresses(pre, post).first().addresses] == [b"a", b"b", b"c"]
    assert {bytes(r.address): len(r.slots) for r in traces.diff_by_contract(traces.storage_diff(pre, post)).collect()} == {b"a": 2, b"b": 1, b"c": 1}


@pytest.fixture(scope="module")
def ledger(spark):
    t = spark.createDataFrame([(5, 0, b"h" * 32, 0, b"f" * 20, None, wide(10**18), 1, 21000, 10**9, 10**9, 0, 0, None, 1, None, None, None)], schema.TRANSACTIONS)
    return Ledger(spark, {"transactions": t, "blocks": blocks_of(spark, [4, 5])}, spark.createDataFrame([("Alice.eth", b"f" * 20)], "name string, address binary"))


def test_queries(ledger):
    q = ledger.query
    assert q("SELECT format_ether(u256_sum(value)) AS s FROM transactions WHERE block_number = :latest_block").first().s == "1.000000 ETH"
    assert q("SELECT count(*) AS n FROM transactions WHERE block_number > :latest_block", latest_block=4).first().n == 1
    assert q("SELECT format_usd(convert_usd(value, :native_token_price)) AS s FROM transactions", native_token_price=2500.5).first().s == "$2,500.50"
    assert q("SELECT count(*) AS n FROM transactions WHERE from_address = resolve('ALICE.eth') OR from_address = resolve('ALICE.eth')").first().n == 1
    assert q("WITH t AS (SELECT 1 AS a) SELECT * FROM t").first().a == 1
    assert q("SELECT u256_to_dec(u256_mul(gas_used, effective_gas_price)) AS c, success FROM transactions ORDER BY 1 LIMIT 1", max_rows=1).first().c == "21000000000000"


@pytest.mark.parametrize("bad", ["DROP TABLE transactions", "INSERT INTO transactions VALUES (1)", "CREATE TABLE x AS SELECT 1", "SELECT * FROM other", "SELECT * FROM parquet.`/tmp`", "SELECT 1 AS a, 2 AS a", "SELECT :native_token_price AS p", "SELECT resolve('bob.eth') AS a", "SELECT resolve('bob.com') AS a", "SELECT u256_sum(value FROM transactions", "SHOW TABLES", "SELECT (SELECT max(x) FROM secret) AS m", "SET a=b",
    "SELECT * FROM IDENTIFIER('secret')", "SELECT * FROM secret", "WITH t AS (SELECT * FROM secret) SELECT * FROM t", "SELECT reflect('java.lang.System','getProperty','user.home') AS r FROM transactions",
    "SELECT java_method('java.lang.System','getProperty','user.home') AS r FROM transactions", "SELECT IDENTIFIER('reflect')('java.lang.System','getProperty','user.home') AS r", "SELECT foreign_udf(gas_used) AS r FROM transactions", "SELECT * FROM range(5)",
    "SELECT 1) UNION ALL (SELECT x FROM secret", "SELECT u256_sum(-gas_used) AS s FROM transactions"])
def test_refused_queries(spark, ledger, bad):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("secret")
    spark.udf.register("foreign_udf", lambda x: x, "bigint")
    with pytest.raises((QueryError, PySparkException)):
        ledger.query(bad).collect()


@pytest.mark.parametrize("f", ["reflect('java.lang.System','getProperty','user.home')", "java_method('java.lang.System','getProperty','user.home')", "IDENTIFIER('reflect')('java.lang.System','getProperty','user.home')", "input_file_name()"])
def test_refused_functions_in_long_queries(ledger, f):
    """Wherever they stand: texts of plans are cut, trees aren't."""
    many = ", ".join(f"{i} AS c{i}" for i in range(60))
    for bad in (f"SELECT {many}, {f} AS r FROM transactions", f"SELECT 1 AS a FROM transactions WHERE 'x' IN ({', '.join(f"'{i}'" for i in range(60))}, {f})", f"SELECT (SELECT max({f}) FROM blocks) AS a", f"WITH t AS (SELECT {f} AS x) SELECT * FROM t", f"SELECT 1 AS a FROM transactions ORDER BY {f}", f"SELECT sum(gas_used) OVER (PARTITION BY {f}) AS a FROM transactions", f"SELECT * FROM (VALUES (1)) LATERAL VIEW explode(array({f})) t AS x"):
        with pytest.raises(QueryError):
            ledger.query(bad)


@pytest.mark.parametrize("bad", ["SELECT TRANSFORM(gas_used) USING 'cat' AS (x) FROM transactions", "WITH RECURSIVE t(n) MAX RECURSION LEVEL 100000 AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT * FROM t", "SELECT * FROM (WITH secret AS (SELECT 1 AS x) SELECT * FROM secret), secret", "SELECT resolve(from_address) AS a FROM transactions", "SELECT u256_sum(1, 2) AS a", "SELECT default.u256_sum(1) AS a", "FROM transactions INSERT INTO x SELECT *", "SELECT * FROM spark_catalog.default.transactions", "SELECT * FROM transactions LATERAL VIEW reflect('a', 'b') t AS x"])
def test_more_refused_queries(spark, ledger, bad):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("secret")
    with pytest.raises((QueryError, PySparkException)):
        ledger.query(bad).collect()


def test_sums_anywhere_in_queries(spark):
    """In ORDER BY, HAVING, FILTER and OVER, of products, nested in others; not in literals and comments."""
    rng = random.Random(4)
    rows = [(f"g{rng.randrange(6)}", rng.randrange(2**62), rng.randrange(2**62), rng.getrandbits(250)) for _ in range(80)] + [("g0", None, 4, None)]
    own = Ledger(spark, {"logs": spark.createDataFrame([(g, a, b, wide(x)) for g, a, b, x in rows], "g string, a long, b long, x binary")})
    sums = {g: (sum(a * b for h, a, b, _ in rows if h == g and a is not None), sum(x for h, *_, x in rows if h == g and x is not None), sum(x for h, a, _, x in rows if h == g and x is not None and a > 2**61)) for g in sorted({r[0] for r in rows})}
    got = own.query("""SELECT g, u256_to_dec(u256_sum(u256_mul(a, b))) AS p, -- u256_sum(
        u256_to_dec(u256_sum ( /* u256_sum(x) */ (x) ) FILTER (WHERE a > 2305843009213693952 AND g <> ')')) AS f, 'u256_sum(v)' AS l
        FROM logs GROUP BY g ORDER BY u256_sum(u256_mul(a, b)) DESC, u256_sum(x), g""").collect()
    assert [tuple(r) for r in got] == [(g, str(p), str(f) if f else None, "u256_sum(v)") for g, (p, _, f) in sorted(sums.items(), key=lambda kv: -kv[1][0])]
    least = sorted(x for _, x, _ in sums.values())[2]
    having = own.query("SELECT g FROM logs GROUP BY g HAVING u256_sum(x) >= unhex(:least) AND u256_sum(DISTINCT x) > X'00' ORDER BY g", args={"least": f"{least:064x}"}).collect()
    assert [r.g for r in having] == [g for g in sorted(sums) if sums[g][1] >= least]
    over = own.query("SELECT g, u256_to_dec(u256_sum(u256_add(a, x)) OVER (PARTITION BY substring(g, 1, 2))) AS s, u256_to_dec(u256_sum(b) OVER w) AS t FROM logs WINDOW w AS (PARTITION BY g)").collect()
    assert {(r.g, r.s, r.t) for r in over} == {(g, str(sum(a + x for h, a, _, x in rows if h == g and a is not None)), str(sum(b for h, _, b, _ in rows if h == g))) for g in sums}
    top = own.query("SELECT g, u256_to_dec(u256_mul(a, b)) AS p, u256_to_dec(u256_mul(X'02', b)) AS q FROM logs WHERE a IS NOT NULL ORDER BY u256_mul(a, b) DESC LIMIT 3").collect()
    assert [(r.g, r.p, r.q) for r in top] == [(g, str(a * b), str(2 * b)) for g, a, b, _ in sorted(rows[:-1], key=lambda r: -r[1] * r[2])[:3]]
    plan = own.query("SELECT g, u256_sum(u256_mul(a, b)) AS s FROM logs GROUP BY g ORDER BY u256_sum(u256_mul(a, b)) DESC")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ledger_")]
    with pytest.raises(PySparkException):
        own.query("SELECT u256_sum(u256_mul(a, -1)) AS s FROM logs").collect()
    with pytest.raises(PySparkException):
        own.query("SELECT u256_sum(y) AS s FROM (SELECT explode(array(u256(1), unhex(repeat('ff', 32)))) AS y)").collect()


def test_recursive_queries(ledger):
    got = ledger.query("WITH RECURSIVE t(n, d) AS (SELECT min(block_number), 0 FROM blocks UNION ALL SELECT b.block_number, d + 1 FROM t JOIN blocks b ON b.block_number = n + 1) SELECT max(d) AS d, count(*) AS n FROM t").first()
    assert tuple(got) == (1, 2)
    deep = "WITH RECURSIVE t(n) {} AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 300) SELECT max(n) AS n FROM t"
    assert ledger.query(deep.format("MAX RECURSION LEVEL 400")).first().n == 300
    with pytest.raises(Exception, match="RECURSION"):  # Spark's own bound of levels
        ledger.query(deep.format("")).collect()
    assert [r.a for r in ledger.query("SELECT a FROM (VALUES (1), (2)) AS t(a) ORDER BY a").collect()] == [1, 2]


def test_operands_of_queries(spark, ledger):
    more = spark.createDataFrame([(g, v, None if v is None else wide(v)) for g, v in (("a", 3), ("a", 3), ("a", 5), ("b", 2**63 - 1), ("b", 1), ("c", None))], "g string, n long, w binary")
    own = Ledger(spark, {"logs": more, "blocks": blocks_of(spark, [9])})
    for c in ("n", "w"):
        rows = own.query(f"SELECT g, u256_to_dec(u256_sum({c})) AS s, u256_to_dec(u256_sum(DISTINCT {c})) AS d, u256_to_dec(u256_sum({c}) FILTER (WHERE n > 3)) AS f FROM logs GROUP BY g ORDER BY g").collect()
        assert [tuple(r) for r in rows] == [("a", "11", "8", "5"), ("b", str(2**63), str(2**63), str(2**63 - 1)), ("c", None, None, None)]
        over = own.query(f"SELECT g, n, u256_to_dec(u256_sum({c}) OVER (PARTITION BY g ORDER BY n)) AS s, u256_to_dec(u256_sum({c}) OVER w) AS t FROM logs WHERE g = 'a' WINDOW w AS (PARTITION BY g) ORDER BY n").collect()
        assert [(r.s, r.t) for r in over] == [("6", "11"), ("6", "11"), ("11", "11")]
    assert own.query("SELECT convert_usd(n, 2.5) AS a, convert_usd(w, 2.5) AS b FROM logs WHERE n = 5").first() == (5 / 10**18 * 2.5,) * 2
    assert own.latest_block() == 9 and ledger.latest_block() == 5  # two ledgers side by side
    assert ledger.query("SELECT count(*) AS n FROM blocks").first().n == 2 and own.query("SELECT count(*) AS n FROM blocks").first().n == 1
    assert own.query("SELECT ')' AS a, u256_to_dec(u256_sum(CASE WHEN g = ')' THEN 0 ELSE n END)) AS s FROM logs WHERE g = 'a'").first().s == "11"


def test_sums_of_very_many_rows(spark):
    """Sums of limbs as they are past 2^31 rows a group, and the bound of 256 bits."""
    most = 2**24 - 1
    for n in (2**31 + 5, 2**38):
        got = spark.range(1).select(u.carried_sums([F.lit(most * n).cast("long")] * 9 + [F.lit(0).cast("long")] * 2).alias("s")).first().s
        assert int.from_bytes(got, "big") == sum(most * n << 24 * i for i in range(9))
    df = spark.createDataFrame([(wide(2**256 - 1),), (b"\x05",), (None,)], "v binary")
    assert bytes(df.where("v is null or length(v) > 1").select(u.u256_sum("v").alias("s")).first().s) == wide(2**256 - 1)
    with pytest.raises(PySparkException):
        df.select(u.u256_sum("v").alias("s")).collect()


def test_row_limit(ledger):
    with pytest.raises(QueryError):
        ledger.query("SELECT * FROM blocks", max_rows=1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, b"\xab", None, "a,b"), (2, None, 1.5, 'q"')], "n int, b binary, d double, s string")
    sinks.write_csv(df.coalesce(1), f"{tmp_path}/csv")
    text = next(p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part-")).read_text()
    assert text.splitlines()[:2] == ["n,b,d,s", '1,0xab,,"a,b"'] and text.splitlines()[2].startswith("2,,1.5,")
    sinks.write_json(df.coalesce(1), f"{tmp_path}/json")
    text = next(p for p in (tmp_path / "json").iterdir() if p.name.startswith("part-")).read_text()
    assert [json.loads(x) for x in text.splitlines()] == [{"n": 1, "b": "0xab", "d": None, "s": "a,b"}, {"n": 2, "b": None, "d": 1.5, "s": 'q"'}]


def test_chains(spark, tmp_path):
    (tmp_path / "chains.json").write_text(json.dumps([{"chainId": 10, "name": "Ten Chain", "chain": "T", "shortName": "tc", "rpc": [], "nativeCurrency": {"name": "x", "symbol": "TEN", "decimals": 18}, "explorers": ["https://a", {"name": "b", "url": "https://b"}]}, {"chainId": 2, "name": "Two", "chain": "TWO", "explorers": [{"url": "https://c"}]}, {"chainId": 3, "name": "Three", "chain": "tri"}]))
    chains = exports.read_chains(spark, f"{tmp_path}/chains.json")
    assert {r.id: r.explorers for r in chains.collect()} == {10: ["https://a", "https://b"], 2: ["https://c"], 3: []}
    assert [(r.id, r.explorer_url) for r in display.find_chains(chains, "T").collect()] == [(2, "https://c"), (3, None), (10, "https://a")]
    assert [r.id for r in display.find_chains(chains, "tc").collect()] == [10] and [r.id for r in display.find_chains(chains, ids=[3, 2], limit=1).collect()] == [2]
    known = chains.select("id", "name", F.get("explorers", F.lit(0)).alias("explorer_url"), "currency_symbol", F.lit("feed").alias("price_feed"))
    got = {r.chain_id: r for r in display.with_chain(spark.createDataFrame([(10,), (99,)], "chain_id long"), known).collect()}
    assert (got[10].chain_name, got[99].chain_name, got[99].currency_symbol, got[99].price_feed) == ("Ten Chain", "Unknown", "???", None)


def test_display_lookups(spark, ledger):
    t = ledger.tables["transactions"]
    with pytest.raises(LookupError):
        display.one_transaction(t, b"no")
    r = display.one_transaction(t, b"h" * 32).first()
    assert r.signature == "<ETH transfer>" and r.display_tx_cost_usd is None and r.coinbase_transfer is None and len(r) == 23
    rows = display.block_rows(ledger.tables["blocks"], t).orderBy("block_number").collect()
    assert [(b.block_number, b.txs_count, b.display_base_fee_per_gas) for b in rows] == [(4, 0, None), (5, 1, None)]
    assert display.with_logs(t, spark.createDataFrame([], schema.LOGS)).first().logs == []


def test_export_files(spark, tmp_path):
    rows = [(n, b"h", b"m", 1, n, None) for n in range(100, 120)]
    text = spark.createDataFrame([("0x" + "ab" * 32, "0x" + "cd" * 20, n, 1, n, None) for n, *_ in rows], schema.BLOCK_EXPORT)
    for low in (100, 110):
        text.where(f"block_number BETWEEN {low} AND {low + 9}").coalesce(1).write.parquet(f"{tmp_path}/w{low}")
        part = next(p for p in (tmp_path / f"w{low}").iterdir() if p.name.startswith("part-"))
        (tmp_path / "exports").mkdir(exist_ok=True)
        part.rename(tmp_path / "exports" / f"ethereum__blocks__{low:08d}_to_{low + 9:08d}.parquet")
    folder = f"{tmp_path}/exports"
    files = exports.manifest(spark, folder)
    assert files.count() == 2 and coverage.stored_bytes(spark, folder) == sum(r.length for r in files.collect()) > 0
    got = exports.read_range(spark, folder, "blocks", 105, 108)
    assert sorted(r.block_number for r in ingest.blocks(got).collect()) == [105, 106, 107, 108]
    assert len(got.inputFiles()) == 1 and exports.read_range(spark, folder, "logs", 0, 9).count() == 0
    spark.createDataFrame([(b"1234", b"a" * 32, "f()"), (None, b"a" * 32, "g()")], exports.SIGNATURES).write.parquet(f"{tmp_path}/sigs")
    spark.createDataFrame([(b"a" * 32, "function"), (b"a" * 32, None)], exports.COMPILED).write.parquet(f"{tmp_path}/kinds")
    methods, events, skipped = signatures.dictionary(exports.read_signatures(spark, f"{tmp_path}/sigs"), exports.read_compiled(spark, f"{tmp_path}/kinds"))
    assert [r.signature for r in methods.collect()] == ["f()"] and events.count() == skipped.count() == 0
