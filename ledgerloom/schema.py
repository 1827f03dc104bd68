"""Schemas of the exports and of the tables made from them."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}[k]) for n, k in (x.split() for x in text.split(","))])


#: Exports as text: bytes are hex with 0x, wide integers decimal.
TX_EXPORT = _struct(
    "block_number long,transaction_index long,transaction_hash string,nonce long,from_address string,to_address string,value_string string,input string,"
    "gas_limit long,gas_used long,gas_price string,transaction_type string,max_priority_fee_per_gas string,max_fee_per_gas string,success boolean"
)
LOG_EXPORT = _struct("block_number long,transaction_index long,log_index long,address string,topic0 string,topic1 string,topic2 string,topic3 string,data string")
BLOCK_EXPORT = _struct("block_hash string,author string,block_number long,gas_used long,timestamp long,base_fee_per_gas string")

TRANSACTIONS = _struct(
    "block_number long,tx_index long,tx_hash binary,nonce long,from_address binary,to_address binary,value binary,gas_limit long,gas_used long,effective_gas_price long,"
    "gas_price long,max_fee_per_gas long,max_priority_fee_per_gas long,transaction_type int,success int,coinbase_transfer binary,signature_hash binary,signature string"
)
LOGS = _struct("block_number long,tx_index long,log_index long,address binary,topic0 binary,topic1 binary,topic2 binary,topic3 binary,data binary,erc20_amount binary,signature string")
BLOCKS = _struct("block_number long,block_hash binary,miner binary,gas_used long,timestamp long,base_fee_per_gas long")

KEYS = {"transactions": ["tx_hash"], "logs": ["block_number", "log_index"], "blocks": ["block_number"]}
TABLES = {"transactions": TRANSACTIONS, "logs": LOGS, "blocks": BLOCKS}
