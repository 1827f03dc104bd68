"""Building the signature dictionary from published signatures and from compiled contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_map(compiled: DataFrame) -> DataFrame:
    """hash32, is_function, is_event for each 32-byte hash that compiled contracts use as one of these."""
    kind = F.col("signature_type")
    good = compiled.where(kind.isin("function", "event") & (F.length("signature_hash_32") == 32))
    return good.groupBy(F.col("signature_hash_32").alias("hash32")).agg(F.max((kind == "function").cast("int")).alias("is_function"), F.max((kind == "event").cast("int")).alias("is_event"))


def dictionary(signatures: DataFrame, compiled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """methods (hash of 4 bytes, signature), events (hash of 32 bytes, signature) and the signatures of no known type."""
    kinds = type_map(compiled)
    full = signatures.where("signature_hash_4 IS NOT NULL AND signature_hash_32 IS NOT NULL AND signature IS NOT NULL")
    joined = full.join(kinds, full["signature_hash_32"] == kinds["hash32"])
    methods = joined.where("is_function = 1").select(F.col("signature_hash_4").alias("hash"), "signature")
    events = joined.where("is_event = 1").select(F.col("signature_hash_32").alias("hash"), "signature")
    return methods, events, full.join(kinds, full["signature_hash_32"] == kinds["hash32"], "left_anti")


def one_text(named: DataFrame) -> DataFrame:
    """One signature for each hash: the smallest text."""
    return named.groupBy("hash").agg(F.min("signature").alias("signature"))
