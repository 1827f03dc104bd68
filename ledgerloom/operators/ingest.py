"""Exports to tables: bytes and numbers parsed, signatures resolved, created contracts named; appends without duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions.keccak import contract_address
from ledgerloom.functions.u256 import from_dec, wide_from_dec

CREATE, UNKNOWN = "CREATE()", "?"
ERC20_TRANSFER = "Transfer(address,address,uint256)"
#: Selectors whose signature is known beforehand at the first place of a block.
OVERRIDES = {(bytes.fromhex("098999be"), 0): "setL1BlockValuesIsthmus()"}
#: Longs that a price may not exceed.
MOST = 2**63 - 1


def to_bytes(column: Column | str) -> Column:
    """Hex text, with or without 0x, as bytes; null is empty; odd or bad hex raises."""
    c = F.col(column) if isinstance(column, str) else column
    text = F.coalesce(c, F.lit(""))
    digits = F.when(F.startswith(text, F.lit("0x")), F.substring(text, 3, 2**31 - 1)).otherwise(text)
    raw = F.when(F.length(text) % 2 == 0, F.unhex(digits))  # null for bad digits; 0x leaves odd lengths odd
    return F.coalesce(raw, F.raise_error(F.concat(F.lit("bad hex: "), c)).cast("binary"))


def or_null(b: Column) -> Column:
    return F.when(F.length(b) > 0, b)


def selector(data: Column, is_creation: Column) -> Column:
    """The first four bytes of a call's input, if it has as many."""
    return F.when(~is_creation & (F.length(data) >= 4), F.substring(data, 1, 4))


def overridden(tx_index: Column, hash4: Column) -> Column:
    out = F.lit(None).cast("string")
    for (hash_, at), text in OVERRIDES.items():
        out = F.when((hash4 == F.lit(hash_)) & (tx_index == at), F.lit(text)).otherwise(out)
    return out


def resolve_method(df: DataFrame, methods: DataFrame, hash4: str = "signature_hash", is_creation: Column | None = None, tx_index: str = "tx_index") -> DataFrame:
    """Adds signature: CREATE() for a creation, an override, the dictionary's text, ? for an unknown selector, null without one.

    methods: hash, signature, one row a hash. The dictionary is small beside the ledger and grows with known
    signatures only; AQE broadcasts it where its size allows, and joins it by shuffle otherwise."""
    known = methods.select(F.col("hash").alias("__hash"), F.col("signature").alias("__text"))
    joined = df.join(known, df[hash4] == known["__hash"], "left")
    text = F.when(F.col(hash4).isNotNull(), F.coalesce(overridden(F.col(tx_index), F.col(hash4)), F.col("__text"), F.lit(UNKNOWN)))
    if is_creation is not None:
        text = F.when(is_creation, F.lit(CREATE)).otherwise(text)
    return joined.withColumn("signature", text).drop("__hash", "__text")


def transactions(export: DataFrame, methods: DataFrame, created: bool = True, wide: bool = False) -> DataFrame:
    """The transactions table of an export; rows with a price over 2^63-1 are left out (see overpriced()).

    created: name the contract that a creation makes, keccak over sender and nonce. wide: values of over 38 digits."""
    price = lambda c: F.coalesce(F.expr(f"try_cast({c} AS DECIMAL(38,0))"), F.lit(0).cast("decimal(38,0)"))
    df = _priced(export)
    to = to_bytes("to_address")
    df = df.select(
        "block_number", F.col("transaction_index").alias("tx_index"), to_bytes("transaction_hash").alias("tx_hash"), "nonce", to_bytes("from_address").alias("from_address"),
        or_null(to).alias("to_address"), (wide_from_dec if wide else from_dec)(F.col("value_string")).alias("value"), "gas_limit", "gas_used",
        F.col("gas_price").cast("decimal(38,0)").cast("long").alias("effective_gas_price"), F.col("gas_price").cast("decimal(38,0)").cast("long").alias("gas_price"),
        price("max_fee_per_gas").cast("long").alias("max_fee_per_gas"), price("max_priority_fee_per_gas").cast("long").alias("max_priority_fee_per_gas"),
        F.expr("try_cast(transaction_type AS INT)").alias("transaction_type"), F.col("success").cast("int").alias("success"), F.lit(None).cast("binary").alias("coinbase_transfer"),
        selector(to_bytes("input"), or_null(to).isNull()).alias("signature_hash"),
    )
    df = resolve_method(df, methods, is_creation=F.col("to_address").isNull())
    if created:  # the Python function sees creations only: they are split off, not chosen by a branch
        new = df.where("to_address IS NULL").withColumn("to_address", contract_address("from_address", "nonce"))
        df = df.where("to_address IS NOT NULL").unionByName(new)
    return df.select(*schema.TRANSACTIONS.fieldNames())


def _over(c: str) -> Column:
    return F.coalesce(F.expr(f"try_cast({c} AS DECIMAL(38,0))") > F.lit(MOST).cast("decimal(38,0)"), F.lit(False))


def _any_over() -> Column:
    return _over("gas_price") | _over("max_fee_per_gas") | _over("max_priority_fee_per_gas")


def _priced(export: DataFrame) -> DataFrame:
    return export.where(~_any_over())


def overpriced(export: DataFrame) -> DataFrame:
    """Rows of an export that transactions() leaves out: a price doesn't fit a long."""
    return export.where(_any_over())


def logs(export: DataFrame, events: DataFrame) -> DataFrame:
    """The logs table of an export. Topics that are absent leave no gap; amounts are those of fungible token transfers."""
    topics = F.array_remove(F.array(*[to_bytes(f"topic{i}") for i in range(4)]), F.lit(b""))
    df = export.select("block_number", F.col("transaction_index").alias("tx_index"), "log_index", to_bytes("address").alias("address"), topics.alias("__topics"), to_bytes("data").alias("data"))
    df = df.select("block_number", "tx_index", "log_index", "address", *[F.get("__topics", i).alias(f"topic{i}") for i in range(4)], "data")
    return with_event(df, events).withColumn("erc20_amount", erc20_amount(F.col("signature"), F.col("data"))).select(*schema.LOGS.fieldNames())


def with_event(df: DataFrame, events: DataFrame) -> DataFrame:
    """Adds signature by topic0; null if it is unknown or absent. events: hash, signature, one row a hash."""
    known = events.select(F.col("hash").alias("__hash"), "signature")
    return df.join(known, df["topic0"] == known["__hash"], "left").drop("__hash")


def erc20_amount(signature: Column, data: Column) -> Column:
    return F.when((signature == ERC20_TRANSFER) & (F.length(data) >= 32), F.substring(data, 1, 32))


def blocks(export: DataFrame) -> DataFrame:
    """The blocks table of an export, one row a block."""
    df = export.select("block_number", to_bytes("block_hash").alias("block_hash"), to_bytes("author").alias("miner"), "gas_used", "timestamp", F.expr("try_cast(base_fee_per_gas AS BIGINT)").alias("base_fee_per_gas"))
    return df.dropDuplicates(["block_number"])


def new_rows(incoming: DataFrame, existing: DataFrame | None, table: str) -> DataFrame:
    """Rows of incoming whose key isn't in existing, one a key; existing rows win."""
    key = schema.KEYS[table]
    once = incoming.dropDuplicates(key)
    if existing is None:
        return once
    # a key's block tells its bucket, so only buckets that incoming touches are read
    return once.join(existing.select(*key), key, "left_anti").select(*incoming.columns)


def _verdicts(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """For each block of incoming: whether its rows are all new and different, whether none is new, whether one has a key that is in another block too."""
    both = lambda *c: incoming.select(*c, F.lit(True).alias("__new")).unionAll(existing.dropna(subset=key).select(*c, F.lit(False).alias("__new")))
    if "block_number" not in key:  # binary keys are shuffled as hashes; two with one hash cost a look at whole rows
        hashed = both(F.xxhash64(*key).alias("__key"), "block_number").groupBy("__key")
        keys = hashed.agg(F.count_if("__new").alias("__n"), F.count_if(~F.col("__new")).alias("__old"), F.min("block_number").alias("block_number"), F.max("block_number").alias("__last")).where("__n > 0")
        whole, none, stray = (F.max("__n") == 1) & (F.max("__old") == 0), F.min("__old") > 0, F.max(F.col("block_number") < F.col("__last"))
    else:  # numbers within blocks are shuffled as bitmaps
        number = next((F.col(c) for c in key if c != "block_number"), F.lit(0)).cast("long")
        bit, new = F.col("__bit"), F.col("__new")
        rows = both("block_number", F.bitmap_bucket_number(number).alias("__bucket"), F.bitmap_bit_position(number).alias("__bit"))
        bits = lambda c: F.bitmap_count(F.bitmap_construct_agg(c))
        counts = [F.count_if(new).alias("__n"), F.count_if(bit.isNull()).alias("__null"), bits(F.when(new, bit)).alias("__in"), bits(F.when(~new, bit)).alias("__old"), bits(bit).alias("__both")]
        keys = rows.groupBy("block_number", "__bucket").agg(*counts)
        n, null, distinct, old, together = (F.sum(c) for c in ("__n", "__null", "__in", "__old", "__both"))
        whole, none, stray = (distinct == n) & (together == distinct + old), (together == old) & (null == 0), F.lit(False)
        return keys.groupBy("block_number").agg(n.alias("__n"), whole.alias("__whole"), none.alias("__none"), stray.alias("__stray")).where("__n > 0")
    return keys.groupBy("block_number").agg(whole.alias("__whole"), none.alias("__none"), stray.alias("__stray"))


def add_new(incoming: DataFrame, existing: DataFrame, key: list[str], add: Callable[[DataFrame], None]) -> None:
    """Call add() with the rows of incoming whose key isn't in existing, one a key, if there are any; incoming is read twice.

    Keys alone are shuffled first, for verdicts on blocks. A block whose rows are all new and different is taken as it comes, one without a new
    row is left out; only what is left goes through a shuffle whole, as does everything if a key is in two blocks."""
    blocks = _verdicts(incoming, existing, key).persist()  # a row a block
    try:
        n, whole, none, stray = blocks.agg(F.count("*"), F.count_if("__whole"), F.count_if("__none"), F.max("__stray")).first()
        of = lambda df, which: df.join(blocks.where(which).select("block_number"), "block_number", "left_semi").select(*df.columns)
        rest = lambda new, old: new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*incoming.columns)
        if stray:
            add(rest(incoming, existing))
        elif whole == n > 0:
            add(incoming)
        elif none < n:
            fresh, mixed = of(incoming, "__whole"), "NOT __whole AND NOT __none"
            add(fresh if whole + none == n else fresh.unionByName(rest(of(incoming, mixed), of(existing, mixed))))
    finally:
        blocks.unpersist()
