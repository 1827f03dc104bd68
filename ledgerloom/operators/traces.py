"""Measures from execution traces: calls, payments to the block producer, touched addresses, storage changes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.u256 import ZERO, hex0x
from ledgerloom.operators.ingest import resolve_method
from ledgerloom.plans.names import ETH_TRANSFER

CALLS = "tx_hash binary, seq int, from_address binary, to_address binary, value binary, input binary"


def _bytes(text: str | None, size: int | None = None) -> bytes | None:
    if text is None:
        return None
    digits = text.removeprefix("0x")
    digits = "0" * (len(digits) % 2) + digits
    out = bytes.fromhex(digits)
    return out if size is None else out.rjust(size, b"\0")


def flatten(trees: DataFrame) -> DataFrame:
    """tx_hash, call (JSON of nested calls) -> a row a call in the order they are made, the root first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tx, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stack, seq = [json.loads(text)] if text else [], 0
                while stack:
                    c = stack.pop()
                    rows.append((tx, seq, _bytes(c.get("from")), _bytes(c.get("to")), _bytes(c.get("value"), 32), _bytes(c.get("input"))))
                    stack += reversed(c.get("calls") or [])
                    seq += 1
            kinds = [pa.binary(), pa.int32(), *[pa.binary()] * 4]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in CALLS.split(", ")])

    return trees.select("tx_hash", "call").mapInArrow(work, CALLS)


def direct_payments(calls: DataFrame, transactions: DataFrame, blocks: DataFrame) -> DataFrame:
    """tx_hash, payment of each traced transaction: the value of its first call to the block's producer that has one, else zero."""
    miners = blocks.select("block_number", "miner").where("miner IS NOT NULL")
    known = transactions.select("tx_hash", "block_number").join(miners, "block_number").select("tx_hash", "miner")
    paid = F.col("value").isNotNull()  # other calls only tell that their transaction is traced
    made = calls.select("tx_hash", *[F.when(paid, F.col(c)).alias(c) for c in ("seq", "to_address", "value")])
    at = F.when(F.col("to_address") == F.col("miner"), F.col("seq"))
    return made.join(known, "tx_hash").groupBy("tx_hash").agg(F.coalesce(F.min_by("value", at), F.lit(ZERO)).alias("payment"))


def backfill(transactions: DataFrame, payments: DataFrame) -> DataFrame:
    """transactions with coinbase_transfer filled in where it is null and a payment is known."""
    known = payments.select("tx_hash", F.col("payment").alias("__payment"))
    filled = F.coalesce("coinbase_transfer", "__payment")
    return transactions.join(known, "tx_hash", "left").withColumn("coinbase_transfer", filled).select(*transactions.columns)


def affected_addresses(pre: DataFrame, post: DataFrame) -> DataFrame:
    """tx_hash, addresses: sorted, each once, of what a transaction's states before and after name."""
    both = pre.select("tx_hash", "address").union(post.select("tx_hash", "address")).distinct()
    return both.groupBy("tx_hash").agg(F.sort_array(F.collect_set("address")).alias("addresses"))


def storage_diff(pre: DataFrame, post: DataFrame) -> DataFrame:
    """tx_hash, address, slot, before, after of the slots that change; an absent value and zero are null.

    pre, post: tx_hash, address, slot, value. They are compared before zero becomes null."""
    key = ["tx_hash", "address", "slot"]
    joined = pre.select(*key, F.col("value").alias("before")).join(post.select(*key, F.col("value").alias("after")), key, "full_outer")
    changed = joined.where(~F.col("before").eqNullSafe(F.col("after")))
    return changed.select(*key, F.nullif("before", F.lit(ZERO)).alias("before"), F.nullif("after", F.lit(ZERO)).alias("after"))


def diff_by_contract(diff: DataFrame) -> DataFrame:
    """tx_hash, address, slots: a map from slot to (before, after), all 0x-hex, in the order of slots."""
    entry = F.struct(hex0x("slot").alias("slot"), F.struct(hex0x("before").alias("before"), hex0x("after").alias("after")).alias("change"))
    return diff.groupBy("tx_hash", "address").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("slots"))


def decoded_calls(calls: DataFrame, transactions: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls with a receiver: tx_hash, seq, from_address, to_address, signature, selector. Overrides go by the transaction's place in its block."""
    hash4: Column = F.when(F.length("input") >= 4, F.substring("input", 1, 4))
    sent = calls.where("to_address IS NOT NULL").withColumn("selector", hash4).join(transactions.select("tx_hash", "tx_index"), "tx_hash")
    named = resolve_method(sent, methods, hash4="selector")
    return named.select("tx_hash", "seq", "from_address", "to_address", F.coalesce("signature", F.lit(ETH_TRANSFER)).alias("signature"), "selector")
