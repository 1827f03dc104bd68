"""Canonical projections of transactions, blocks and logs, and the chain dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.display import convert_usd, format_usd, gwei_of_long
from ledgerloom.functions.u256 import format_ether, mul_longs, u256_add, u256_to_dec
from ledgerloom.plans.names import ETH_TRANSFER, UNKNOWN_CHAIN, UNKNOWN_CURRENCY

TOPICS = ["topic0", "topic1", "topic2", "topic3"]


def transaction_rows(transactions: DataFrame, price: float | None = None) -> DataFrame:
    """23 columns of each transaction. Costs with the payment to the producer are null where that isn't traced. Filter and order outside: filters reach the scan."""
    df = transactions.withColumn("__cost", mul_longs("gas_used", "effective_gas_price"))
    df = df.withColumn("__full", u256_add("__cost", "coinbase_transfer"))
    usd = lambda c: format_usd(convert_usd(c, price))
    return df.select(
        "block_number", "tx_index", "tx_hash", F.col("from_address").alias("from"), F.col("to_address").alias("to"), "nonce", F.coalesce("signature", F.lit(ETH_TRANSFER)).alias("signature"), "signature_hash", "success",
        u256_to_dec("value").alias("value"), format_ether("value").alias("display_value"), "gas_used", F.col("effective_gas_price").alias("gas_price"), gwei_of_long("effective_gas_price").alias("display_gas_price"),
        u256_to_dec("__cost").alias("tx_cost"), format_ether("__cost").alias("display_tx_cost"), usd("__cost").alias("display_tx_cost_usd"),
        u256_to_dec("coinbase_transfer").alias("coinbase_transfer"), format_ether("coinbase_transfer").alias("display_coinbase_transfer"), usd("coinbase_transfer").alias("display_coinbase_transfer_usd"),
        u256_to_dec("__full").alias("full_tx_cost"), format_ether("__full").alias("display_full_tx_cost"), usd("__full").alias("display_full_tx_cost_usd"),
    )


def one_transaction(transactions: DataFrame, tx_hash: bytes, price: float | None = None) -> DataFrame:
    """transaction_rows() of one hash; an unknown hash raises LookupError."""
    found = transactions.where(F.col("tx_hash") == F.lit(tx_hash))
    if found.isEmpty():
        raise LookupError(f"no transaction 0x{tx_hash.hex()}")
    return transaction_rows(found, price)


def block_transactions(transactions: DataFrame, block: int | Column, price: float | None = None) -> DataFrame:
    return transaction_rows(transactions.where(F.col("block_number") == block), price).orderBy("tx_index")


def block_rows(blocks: DataFrame, transactions: DataFrame) -> DataFrame:
    """Blocks with their base fee in gwei and the number of their transactions, 0 for empty ones."""
    counts = transactions.groupBy("block_number").agg(F.count("*").alias("__n"))
    return blocks.join(counts, "block_number", "left").select("block_number", "block_hash", "miner", "gas_used", "timestamp", "base_fee_per_gas", gwei_of_long("base_fee_per_gas").alias("display_base_fee_per_gas"), F.coalesce("__n", F.lit(0)).alias("txs_count"))


def log_rows(logs: DataFrame, with_tx: bool = False) -> DataFrame:
    """Logs of a transaction, or with_tx of a block; the caller filters."""
    df = logs.select(*["tx_index"] * with_tx, "log_index", "address", "signature", *TOPICS, "data", u256_to_dec("erc20_amount").alias("erc20_amount"))
    return df.orderBy(*["tx_index"] * with_tx, "log_index")


def with_logs(transactions: DataFrame, logs: DataFrame) -> DataFrame:
    """Transactions with an array of their logs in order, empty without any."""
    kept = ["log_index", "address", "signature", *TOPICS, "data", "erc20_amount"]
    key = ["block_number", "tx_index"]
    nested = logs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("logs"))
    joined = transactions.join(nested, key, "left")
    return joined.withColumn("logs", F.coalesce("logs", F.array().cast(nested.schema["logs"].dataType)))


def with_chain(df: DataFrame, chains: DataFrame) -> DataFrame:
    """df (with chain_id) with the chain's name, explorer, currency and price feed; an unknown chain has stand-ins."""
    known = chains.select(F.col("id").alias("__id"), F.col("name").alias("__name"), "explorer_url", F.col("currency_symbol").alias("__symbol"), "price_feed")
    joined = df.join(known, df["chain_id"] == known["__id"], "left")
    return joined.select(*df.columns, F.coalesce("__name", F.lit(UNKNOWN_CHAIN)).alias("chain_name"), "explorer_url", F.coalesce("__symbol", F.lit(UNKNOWN_CURRENCY)).alias("currency_symbol"), "price_feed")


def find_chains(chains: DataFrame, text: str | None = None, ids: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """Chains by a part of their name or short name, whatever the case, or by id; sorted by id, with the first explorer."""
    if text:
        chains = chains.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("short_name"), F.lit(text.lower())))
    if ids is not None:
        chains = chains.where(F.col("id").isin(ids))
    out = chains.select("id", "name", "short_name", "currency_symbol", F.get("explorers", F.lit(0)).alias("explorer_url")).orderBy("id")
    return out if limit is None else out.limit(limit)
