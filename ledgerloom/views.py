"""Ledger-shaped exports and tables derived from the order tables, in Spark and as SQL text for another engine."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.u256 import from_long, mul_longs
from ledgerloom.operators import ingest

TRANSFER = "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
SWAP = "d78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822"
METHODS = {"a9059cbb": "transfer(address,uint256)", "022c0d9f": "swap(uint256,uint256,address,bytes)"}
EVENTS = {TRANSFER: "Transfer(address,address,uint256)", SWAP: "Swap(address,uint256,uint256,uint256,uint256,address)"}
SELECTORS = {"1-URGENT": "a9059cbb", "2-HIGH": "022c0d9f", "3-MEDIUM": "", "4-NOT SPECIFIED": "deadbeef", "5-LOW": "6080"}


class Exports(NamedTuple):
    transactions: DataFrame
    logs: DataFrame
    blocks: DataFrame


class Tables(NamedTuple):
    transactions: DataFrame
    logs: DataFrame
    blocks: DataFrame
    methods: DataFrame
    events: DataFrame


#: The JVM leaves methods over 8,000 bytes uncompiled. Spark then takes the operators of a stage one by one, with code in small methods.
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    if int(spark.conf.get(HUGE_METHOD)) > 8000:
        spark.conf.set(HUGE_METHOD, 8000)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def h(prefix: str, c: Column) -> Column:
    return F.sha2(F.concat(F.lit(prefix), c.cast("string")).cast("binary"), 256)


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _x(c: Column) -> Column:
    return F.concat(F.lit("0x"), c)


def block_number() -> Column:
    return F.lit(1_000_000).cast("long") + F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))


def _orders(spark: SparkSession, sf_dir: str, size: int | None = None) -> DataFrame:
    o, key = read(spark, sf_dir, "orders").withColumn("block_number", block_number()), ["block_number"]
    if size is not None:
        o, key = o.withColumn("k", F.floor(F.col("block_number") / size)).repartition("k"), ["k", "block_number"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("o_orderkey")) - 1
    return o.withColumn("tx_index", place.cast("long"))


def exports(spark: SparkSession, sf_dir: str, size: int | None = None) -> Exports:
    """size: rows of that many blocks come together, with k, the number of their part, so that files of them need no shuffle of the text."""
    part = [] if size is None else ["k"]
    o = _orders(spark, sf_dir, size)
    price, priority = F.lit(10**9) + cents("o_totalprice"), F.col("o_orderpriority")
    data = F.lit("")
    for p, s in SELECTORS.items():
        data = F.when(priority == p, F.lit(s)).otherwise(data)
    tx = o.select(
        *part, "block_number", F.col("tx_index").alias("transaction_index"), _x(h("t", F.col("o_orderkey"))).alias("transaction_hash"), (F.col("o_orderkey") % 1000).alias("nonce"),
        _x(F.left(h("c", F.col("o_custkey")), F.lit(40))).alias("from_address"), F.when(priority != "5-LOW", _x(F.left(h("p", F.col("o_orderkey") % 97), F.lit(40)))).alias("to_address"),
        F.concat(cents("o_totalprice").cast("string"), F.lit("0" * 16)).alias("value_string"), _x(data).alias("input"), F.lit(500_000).cast("long").alias("gas_limit"),
        (21_000 + (F.col("o_orderkey") % 479) * 1000).alias("gas_used"), price.cast("string").alias("gas_price"), F.when(priority != "4-NOT SPECIFIED", F.left(priority, F.lit(1))).alias("transaction_type"),
        F.lit("1000000000").alias("max_priority_fee_per_gas"), (2 * price).cast("string").alias("max_fee_per_gas"), (F.col("o_orderstatus") != "F").alias("success"),
    )
    word = lambda c: F.hex(from_long(c))
    kind, line = F.col("l_returnflag"), read(spark, sf_dir, "lineitem")
    order = ["tx_index", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = line.join(o.select(*part, "o_orderkey", "o_custkey", "block_number", "tx_index"), line["l_orderkey"] == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
    lines = lines if size is None else lines.repartition("k")
    lines = lines.withColumn("log_index", (F.row_number().over(Window.partitionBy(*part, "block_number").orderBy(*order)) - 1).cast("long"))
    words = F.concat(F.hex(mul_longs(cents("l_extendedprice"), F.lit(10**12))), word(F.round("l_quantity").cast("long")), word(F.round(F.col("l_discount") * 10_000).cast("long")), word(F.round(F.col("l_tax") * 10_000).cast("long")))
    padded = lambda prefix, c: _x(F.concat(F.lit("0" * 24), F.left(h(prefix, F.col(c)), F.lit(40))))
    topic0 = F.when(kind == "R", F.lit(TRANSFER)).when(kind == "A", F.lit(SWAP)).otherwise(h("n", F.lit("")))
    logs = lines.select(
        *part, "block_number", F.col("tx_index").alias("transaction_index"), "log_index", _x(F.left(h("p", F.col("l_partkey") % 50), F.lit(40))).alias("address"), _x(topic0).alias("topic0"), padded("s", "l_suppkey").alias("topic1"), padded("c", "o_custkey").alias("topic2"),
        F.lit(None).cast("string").alias("topic3"), _x(F.when((kind == "R") & (F.col("l_linestatus") == "O"), F.lit("")).otherwise(words)).alias("data"),
    )
    n = F.col("block_number")
    blocks = o.groupBy(*part, "block_number").agg(F.sum(21_000 + (F.col("o_orderkey") % 479) * 1000).alias("gas_used"), F.unix_timestamp(F.min("o_orderdate")).alias("timestamp"))
    fee = F.when(n % 5 != 0, F.lit(10**9) + (n % 1000) * 1_000_000).cast("string")
    blocks = blocks.select(*part, _x(h("b", n)).alias("block_hash"), _x(F.left(h("m", n % 7), F.lit(40))).alias("author"), "block_number", "gas_used", "timestamp", fee.alias("base_fee_per_gas"))
    return Exports(tx, logs, blocks)


def named(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """hash, signature of a few fixed names."""
    return spark.sql(" UNION ALL ".join(f"SELECT unhex('{k}') AS hash, '{v}' AS signature" for k, v in names.items()))


def tables(spark: SparkSession, sf_dir: str, created: bool = False) -> Tables:
    """The three tables as ingest makes them of the exports; a created contract's address stays null unless asked for."""
    e, methods, events = exports(spark, sf_dir), named(spark, METHODS), named(spark, EVENTS)
    return Tables(ingest.transactions(e.transactions, methods, created=created), ingest.logs(e.logs, events), ingest.blocks(e.blocks), methods, events)


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_hash, payment of the traced orders: none for status P, zero for O."""
    paid = F.when(F.col("o_orderstatus") == "F", mul_longs(cents("o_totalprice"), F.lit(10**9))).otherwise(from_long(F.lit(0).cast("long")))
    return read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.unhex(h("t", F.col("o_orderkey"))).alias("tx_hash"), paid.alias("payment"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each line of an order, to the block's producer where the line's number is 3."""
    o = _orders(spark, sf_dir).select("o_orderkey", "block_number")
    line = read(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    df = line.join(o, line["l_orderkey"] == o["o_orderkey"]).withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1)
    to = F.when(F.col("l_linenumber") == 3, F.left(h("m", F.col("block_number") % 7), F.lit(40))).when(F.col("l_linenumber") != 5, F.left(h("s", F.col("l_suppkey")), F.lit(40)))
    data = F.when(F.col("l_returnflag") == "R", F.lit("a9059cbb")).when(F.col("l_returnflag") == "A", F.lit("deadbeef")).otherwise(F.lit(""))
    return df.select(
        F.unhex(h("t", F.col("l_orderkey"))).alias("tx_hash"), "seq", F.unhex(F.left(h("c", F.col("l_partkey")), F.lit(40))).alias("from_address"), F.unhex(to).alias("to_address"),
        F.when(F.col("l_returnflag") != "N", from_long(cents("l_extendedprice"))).alias("value"), F.unhex(data).alias("input"),
    )


def storage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Storage before and after: tx_hash, address, slot, value, from two subsets of lines; some values are zero, some alike."""
    line = read(spark, sf_dir, "lineitem")
    key = [F.unhex(h("t", F.col("l_orderkey"))).alias("tx_hash"), F.unhex(F.left(h("p", F.col("l_partkey")), F.lit(40))).alias("address"), from_long(F.col("l_linenumber").cast("long")).alias("slot")]
    quantity = F.round("l_quantity").cast("long")
    grouped = lambda where, value: line.where(where).groupBy(*key).agg(F.max(value).alias("v")).select("tx_hash", "address", "slot", from_long("v").alias("value"))
    return grouped("l_linenumber <= 4", quantity % 5), grouped("l_linenumber >= 2", F.when(F.col("l_returnflag") == "R", F.lit(0).cast("long")).otherwise(quantity % 5))


# --- the same as SQL text, with bytes as hex ---

_C = "CAST(round({} * 100) AS BIGINT)"
LEDGER_SQL = f"""
t_orders AS (SELECT *, 1000000 + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS block_number, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS tx_index, {_C.format('o_totalprice')} AS c FROM orders),
t_tx AS (SELECT o_orderkey, block_number, tx_index, sha256('t' || o_orderkey) AS tx_hash, o_orderkey % 1000 AS nonce, left(sha256('c' || o_custkey), 40) AS from_address,
  CASE WHEN o_orderpriority <> '5-LOW' THEN left(sha256('p' || (o_orderkey % 97)), 40) END AS to_address, c::HUGEINT * 10000000000000000 AS value, 500000 AS gas_limit, 21000 + (o_orderkey % 479) * 1000 AS gas_used,
  1000000000 + c AS gas_price, 2 * (1000000000 + c) AS max_fee, 1000000000 AS max_priority, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(left(o_orderpriority, 1) AS INT) END AS transaction_type,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS success, CASE o_orderpriority WHEN '1-URGENT' THEN 'a9059cbb' WHEN '2-HIGH' THEN '022c0d9f' WHEN '4-NOT SPECIFIED' THEN 'deadbeef' END AS selector,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'transfer(address,uint256)' WHEN '2-HIGH' THEN 'swap(uint256,uint256,address,bytes)' WHEN '4-NOT SPECIFIED' THEN '?' WHEN '5-LOW' THEN 'CREATE()' END AS signature,
  CASE o_orderstatus WHEN 'O' THEN 0::HUGEINT WHEN 'F' THEN c::HUGEINT * 1000000000 END AS coinbase, (21000 + (o_orderkey % 479) * 1000)::HUGEINT * (1000000000 + c) AS cost FROM t_orders),
t_blocks AS (SELECT block_number, sha256('b' || block_number) AS block_hash, left(sha256('m' || (block_number % 7)), 40) AS miner, sum(21000 + (o_orderkey % 479) * 1000)::BIGINT AS gas_used, CAST(epoch(min(o_orderdate)) AS BIGINT) AS timestamp,
  CASE WHEN block_number % 5 <> 0 THEN 1000000000 + (block_number % 1000) * 1000000 END AS base_fee_per_gas FROM t_orders GROUP BY block_number),
t_logs AS (SELECT block_number, tx_index, row_number() OVER (PARTITION BY block_number ORDER BY tx_index, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS log_index,
  left(sha256('p' || (l_partkey % 50)), 40) AS address, CASE l_returnflag WHEN 'R' THEN '{TRANSFER}' WHEN 'A' THEN '{SWAP}' ELSE sha256('n') END AS topic0,
  repeat('0', 24) || left(sha256('s' || l_suppkey), 40) AS topic1, repeat('0', 24) || left(sha256('c' || o_custkey), 40) AS topic2, NULL::VARCHAR AS topic3,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '' ELSE lpad(lower(hex({_C.format('l_extendedprice')}::HUGEINT * 1000000000000)), 64, '0') || lpad(lower(hex(CAST(round(l_quantity) AS BIGINT))), 64, '0')
    || lpad(lower(hex(CAST(round(l_discount * 10000) AS BIGINT))), 64, '0') || lpad(lower(hex(CAST(round(l_tax * 10000) AS BIGINT))), 64, '0') END AS data,
  CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'O' THEN {_C.format('l_extendedprice')}::HUGEINT * 1000000000000 END AS amount,
  CASE WHEN l_returnflag = 'A' THEN {_C.format('l_extendedprice')}::HUGEINT * 1000000000000 END AS swap0,
  CASE l_returnflag WHEN 'R' THEN 'Transfer(address,address,uint256)' WHEN 'A' THEN 'Swap(address,uint256,uint256,uint256,uint256,address)' END AS signature, l_orderkey FROM lineitem JOIN t_orders ON l_orderkey = o_orderkey),
t_calls AS (SELECT l_orderkey, sha256('t' || l_orderkey) AS tx_hash, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS seq,
  left(sha256('c' || l_partkey), 40) AS from_address, CASE WHEN l_linenumber = 3 THEN left(sha256('m' || (block_number % 7)), 40) WHEN l_linenumber <> 5 THEN left(sha256('s' || l_suppkey), 40) END AS to_address,
  CASE WHEN l_returnflag <> 'N' THEN {_C.format('l_extendedprice')} END AS value, CASE l_returnflag WHEN 'R' THEN 'a9059cbb' WHEN 'A' THEN 'deadbeef' END AS selector, block_number, tx_index FROM lineitem JOIN t_orders ON l_orderkey = o_orderkey),
t_pre AS (SELECT sha256('t' || l_orderkey) AS tx_hash, left(sha256('p' || l_partkey), 40) AS address, l_linenumber AS slot, max(CAST(round(l_quantity) AS BIGINT) % 5) AS v FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL),
t_post AS (SELECT sha256('t' || l_orderkey) AS tx_hash, left(sha256('p' || l_partkey), 40) AS address, l_linenumber AS slot, max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(round(l_quantity) AS BIGINT) % 5 END) AS v FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL)"""


def sql(select: str, more: str = "") -> str:
    """A query over the derived tables t_tx, t_blocks, t_logs, t_calls, t_pre and t_post."""
    return f"WITH {LEDGER_SQL}{', ' + more if more else ''}\n{select}"


def sql_wide(c: str) -> str:
    """32 bytes of a number as hex."""
    return f"lpad(lower(hex({c})), 64, '0')"


def sql_ether(c: str) -> str:
    q = f"(({c} + 500000000000) // 1000000000000)"
    return f"({q} // 1000000) || '.' || lpad(CAST({q} % 1000000 AS VARCHAR), 6, '0') || ' ETH'"


def sql_gwei(c: str) -> str:
    q = f"(({c} + 5000000) // 10000000)"
    return f"({q} // 100) || '.' || lpad(CAST({q} % 100 AS VARCHAR), 2, '0') || ' gwei'"


def sql_usd(c: str) -> str:
    return f"'$' || format('{{:,.2f}}', {c})"


def sql_price(c: str, price: float) -> str:
    """Ether of wei times a price, as dollars."""
    return sql_usd(f"CAST({c} AS DOUBLE) / 1e18 * {price}")
