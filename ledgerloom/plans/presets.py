"""Ready-made queries. Ties at a limit are broken by the place in the ledger. "The last day" ends at the newest block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.display import byte_size, convert_usd, format_usd
from ledgerloom.functions.u256 import ZERO, erc20_to_real, format_ether, hex0x, mul_longs, sum_of_products, u256_sum, u256_to_dec
from ledgerloom.operators.coverage import Range, head, in_range, statistics

DAY = 86_400


def recent(df: DataFrame, blocks: DataFrame, seconds: int = DAY, now: int | None = None) -> DataFrame:
    """Rows of blocks that are at most `seconds` old. Times rise with block numbers, so the bound becomes one on block_number, which prunes the scan."""
    if now is None:  # in one job
        newest = blocks.agg(F.max("timestamp").alias("now"))
        first = blocks.join(F.broadcast(newest), F.col("timestamp") >= F.col("now") - seconds).agg(F.min("block_number")).first()[0]  # one row
    else:
        first = blocks.where(F.col("timestamp") >= now - seconds).agg(F.min("block_number")).first()[0]
    return df.where(F.col("block_number") >= (first if first is not None else 2**62))


def last_blocks(df: DataFrame, blocks: DataFrame, n: int, latest: int | None = None) -> DataFrame:
    """Rows of blocks over latest - n."""
    return df.where(F.col("block_number") > (latest if latest is not None else head(blocks) or 0) - n)


def cost() -> Column:
    return mul_longs("gas_used", "effective_gas_price")


def gas() -> Column:
    """An aggregate: the sum of the costs."""
    return sum_of_products("gas_used", "effective_gas_price")


def account_gas(transactions: DataFrame, blocks: DataFrame, address: Column, price: float, seconds: int = DAY) -> DataFrame:
    df = recent(transactions, blocks, seconds).where(F.col("from_address") == address).agg(F.count("*").alias("txs"), gas().alias("__gas"))
    return df.select("txs", format_ether("__gas").alias("gas_spent_eth"), format_usd(convert_usd("__gas", price)).alias("gas_spent_usd"))


def top_token_transactions(transactions: DataFrame, logs: DataFrame, blocks: DataFrame, token: Column, decimals: int, n_blocks: int, limit: int = 10) -> DataFrame:
    sums = logs.where((F.col("address") == token) & F.col("erc20_amount").isNotNull() & (F.col("block_number") >= (head(blocks) or 0) - n_blocks)).groupBy("block_number", "tx_index").agg(u256_sum("erc20_amount").alias("__amount"))
    top = sums.orderBy(F.desc("__amount"), "block_number", "tx_index").limit(limit)
    met = transactions.select("block_number", "tx_index", "tx_hash").join(F.broadcast(top), ["block_number", "tx_index"])  # `limit` rows
    return met.orderBy(F.desc("__amount"), "block_number", "tx_index").select(hex0x("tx_hash").alias("tx_hash"), format_usd(erc20_to_real("__amount", decimals)).alias("usdc"))


def top_gas_transactions(transactions: DataFrame, blocks: DataFrame, price: float, seconds: int = DAY, limit: int = 10) -> DataFrame:
    top = recent(transactions, blocks, seconds).select("block_number", "tx_index", "tx_hash", cost().alias("__cost")).orderBy(F.desc("__cost"), "block_number", "tx_index").limit(limit)
    return top.select("block_number", hex0x("tx_hash").alias("tx_hash"), format_ether("__cost").alias("gas_eth"), format_usd(convert_usd("__cost", price)).alias("gas_usd"))


def top_transfers(transactions: DataFrame, blocks: DataFrame, price: float, seconds: int = DAY, limit: int = 10) -> DataFrame:
    top = recent(transactions, blocks, seconds).select("block_number", "tx_index", "tx_hash", "value").orderBy(F.desc("value"), "block_number", "tx_index").limit(limit)
    return top.select(hex0x("tx_hash").alias("tx_hash"), format_ether("value").alias("value_eth"), format_usd(convert_usd("value", price)).alias("value_usd"))


def top_methods(transactions: DataFrame, blocks: DataFrame, seconds: int = DAY, limit: int = 15) -> DataFrame:
    return recent(transactions, blocks, seconds).where("signature IS NOT NULL").groupBy("signature").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "signature").limit(limit)


def method_gas(transactions: DataFrame, blocks: DataFrame, price: float, seconds: int = DAY, limit: int = 10) -> DataFrame:
    """The methods that burned most gas, with their calls."""
    sums = recent(transactions, blocks, seconds).where("signature IS NOT NULL").groupBy("signature").agg(F.count("*").alias("calls"), gas().alias("__gas"))
    top = sums.orderBy(F.desc("__gas"), "signature").limit(limit)
    return top.select("signature", "calls", format_ether("__gas").alias("gas_eth"), format_usd(convert_usd("__gas", price)).alias("gas_usd"))


def new_contracts(transactions: DataFrame, blocks: DataFrame, seconds: int = DAY) -> DataFrame:
    return recent(transactions, blocks, seconds).where("signature = 'CREATE()' AND success = 1").agg(F.count("*").alias("contracts_deployed"))


def top_producers(blocks: DataFrame, seconds: int = DAY, limit: int = 5) -> DataFrame:
    counts = recent(blocks, blocks, seconds).groupBy("miner").agg(F.count("*").alias("blocks_mined"))
    return counts.orderBy(F.desc("blocks_mined"), "miner").limit(limit).select(hex0x("miner").alias("miner"), "blocks_mined")


def store_stats(transactions: DataFrame, logs: DataFrame, blocks: DataFrame, size: Column) -> DataFrame:
    return statistics(transactions, logs, blocks).withColumn("db_size", byte_size(size))


def token_volume(logs: DataFrame, blocks: DataFrame, token: Column, decimals: int, n_blocks: int) -> DataFrame:
    df = logs.where((F.col("address") == token) & F.col("erc20_amount").isNotNull() & (F.col("block_number") >= (head(blocks) or 0) - n_blocks))
    return df.agg(u256_sum("erc20_amount").alias("__sum")).select(erc20_to_real("__sum", decimals).alias("total_usdc"))


def top_values(transactions: DataFrame, limit: int = 5) -> DataFrame:
    top = transactions.select("block_number", "tx_index", "tx_hash", "value").orderBy(F.desc("value"), "block_number", "tx_index").limit(limit)
    return top.select(hex0x("tx_hash").alias("tx_hash"), u256_to_dec("value").alias("value_wei"))


def top_payments(transactions: DataFrame, limit: int = 20) -> DataFrame:
    paid = transactions.where(F.col("coinbase_transfer").isNotNull() & (F.col("coinbase_transfer") != F.lit(ZERO)))
    top = paid.select("block_number", "tx_index", "tx_hash", "coinbase_transfer").orderBy(F.desc("coinbase_transfer"), "block_number", "tx_index").limit(limit)
    return top.select(hex0x("tx_hash").alias("tx_hash"), format_ether("coinbase_transfer").alias("bribe"))


def bought(event_rows: DataFrame, pool: Column, amount: str, decimals: int) -> DataFrame:
    """Sum of an amount column of an event table over one pool."""
    return event_rows.where(F.col("address") == pool).agg(u256_sum(amount).alias("__sum")).select(format_usd(erc20_to_real("__sum", decimals)).alias("usdc_bought"))


def most_expensive(transactions: DataFrame, r: Range) -> DataFrame:
    top = in_range(transactions, r).select("block_number", "tx_index", "tx_hash", cost().alias("__cost")).orderBy(F.desc("__cost"), "block_number", "tx_index").limit(1)
    return top.select(hex0x("tx_hash").alias("tx_hash"), format_ether("__cost").alias("cost"))


def failed(transactions: DataFrame, block: int | Column) -> DataFrame:
    return transactions.where((F.col("block_number") == block) & (F.col("success") == 0)).select(hex0x("tx_hash").alias("tx_hash"), "signature")


def sent_by(transactions: DataFrame, blocks: DataFrame, address: Column, n_blocks: int = 50) -> DataFrame:
    df = last_blocks(transactions, blocks, n_blocks).where(F.col("from_address") == address)
    return df.select(hex0x("tx_hash").alias("tx_hash"), format_ether("value").alias("eth"))


def costliest_of_block(transactions: DataFrame, block: int | Column, limit: int = 10) -> DataFrame:
    top = transactions.where(F.col("block_number") == block).select("tx_index", "tx_hash", cost().alias("__cost")).orderBy(F.desc("__cost"), "tx_index").limit(limit)
    return top.select(hex0x("tx_hash").alias("tx_hash"), u256_to_dec("__cost").alias("cost_wei"))
