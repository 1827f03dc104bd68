"""Sharding by a k-d tree over metadata, with shards of nearly equal bytes. Built-in functions only.

What is dealt are groups of equal texts, which stay in one shard: a group weighs the sizes of its rows and lies
where the least of its rows' coordinates are. A group of at least the mean of what is left is a shard of its own,
as it is a leaf that has reached its bytes. A node of m shards is split where floor(m / 2) / m of its bytes lie below,
along the dimension in which its groups spread most, until a node is one shard. All nodes of a level are split together:
groups are dealt by ranges of (node, value, digest), sums of the ranges give what lies before each range, and a running sum
inside a range the rest, so no task holds a node. Small groups are cut apart from the others, where they make up for what
large ones leave on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import Scratch, fresh, join_apart, quoted, row_digest, row_digest_of, text_bytes

SHARDS, OVERHEAD = 24, 8
DIMENSIONS = ("lang", "source", "n_chars")
SLOT_BUCKETS = 256
#: Groups of at most this part of a shard's bytes are small.
SMALL = 256
#: Repeated rows that are made at once.
TURNS = 4096

Before = Window.unboundedPreceding, -1


def coordinate(df: DataFrame, column: str) -> Column:
    """A column as a number to split by: numbers as they are, anything else by a digest of its text; null is least."""
    if column not in df.columns:
        return F.lit(0.0)
    if isinstance(df.schema[column].dataType, T.NumericType):
        return F.coalesce(F.nanvl(df[column].cast("double"), F.lit(-1.0)), F.lit(-1.0))
    return F.coalesce(F.conv(F.substring(F.md5(df[column].cast("string").cast("binary")), 1, 8), 16, 10).cast("double"), F.lit(-1.0))


def _mark() -> Column:
    return F.unhex(F.md5(text_bytes()))


def _slim(docs: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    size = (F.octet_length(text_bytes()) + OVERHEAD).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), size.alias("size"), F.crc32(text_bytes()).alias("crc"), *[coordinate(docs, c).alias(f"d{i}") for i, c in enumerate(dimensions)])


def _dec(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _sum_before(value: Column | str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(*Before)), F.lit(0))


def group_shards(groups: DataFrame, scratch: Scratch, shards: int, dims: list[str]) -> DataFrame:
    """groups: mark, bytes, n and dims. Returns mark, n and shard of each."""
    whole = groups.agg(F.sum("bytes").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    if whole["bytes"] is None:
        return groups.select("mark", "n", F.lit(0).alias("shard"))
    order = Window.orderBy(F.desc("bytes"), "mark")
    largest = groups.orderBy(F.desc("bytes"), "mark").limit(shards)  # at most one row a shard
    largest = largest.select("mark", "n", "bytes", F.row_number().over(order).alias("turn"), _sum_before("bytes", order).alias("before"))
    alone = largest.where(_dec("bytes") * (shards + 1 - F.col("turn")) >= F.lit(whole["bytes"]) - F.col("before"))
    alone = scratch.cut(alone.select("mark", "n", (shards - F.col("turn")).cast("int").alias("shard")))
    left = shards - alone.count()
    items = groups.join(F.broadcast(alone.select("mark")), "mark", "left_anti").select("mark", "n", "bytes", *dims, F.lit(0).alias("node"), F.lit(left).alias("m"))
    spread = [max(whole[d], 1.0) for d in dims]
    done = None
    for _ in range(max(left - 1, 0).bit_length()):
        after = _split(items, scratch, dims, spread)
        if done is not None:
            scratch.drop(done)
        done, items = after
    return items.select("mark", "n", F.col("node").alias("shard")).unionByName(alone)


def _split(items: DataFrame, scratch: Scratch, dims: list[str], spread: list[float]) -> tuple[DataFrame, DataFrame]:
    """Both halves of every node: a written table, and items as they follow from it."""
    width = F.array(*[(F.max(d) - F.min(d)) / F.lit(s) for d, s in zip(dims, spread, strict=True)]) if dims else F.array(F.lit(0.0))
    nodes = items.groupBy("node", "m").agg(F.sum("bytes").alias("all"), width.alias("width"))
    nodes = nodes.select("node", "all", F.floor(F.col("m") / 2).cast("int").alias("few"), F.array_position("width", F.array_max("width")).cast("int").alias("wide"))  # at most one row a shard
    value = F.element_at(F.array(*dims), F.col("wide")) if dims else F.lit(0.0)
    valued = items.join(F.broadcast(nodes), "node").withColumn("value", value).withColumn("small", _dec("bytes") * F.col("m") * SMALL <= _dec("all"))
    ranged = valued.drop("wide").repartitionByRange(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node", "value", "mark")
    ranged = scratch.cut(ranged.withColumn("range", F.spark_partition_id()))
    light = F.when(F.col("small"), F.col("bytes")).otherwise(F.lit(0))
    per = ranged.groupBy("node", "range").agg(F.sum("bytes").alias("__all"), F.sum(light).alias("__small"))
    earlier = Window.partitionBy("node").orderBy("range")
    per = per.select("node", "range", _sum_before("__all", earlier).alias("__all"), _sum_before("__small", earlier).alias("__small"))
    inside = Window.partitionBy("node", "range").orderBy("value", "mark")
    summed = ranged.withColumn("before", _sum_before("bytes", inside)).withColumn("below", _sum_before(light, inside)).join(per, ["node", "range"])
    middle = lambda before: _dec(2 * before + F.col("bytes")) * F.col("m")
    right = middle(F.col("before") + F.col("__all")) >= 2 * _dec("all") * F.col("few")
    summed = summed.select("mark", "n", "bytes", *dims, "node", "m", "all", "few", "small", (F.col("below") + F.col("__small")).alias("below"), right.alias("right"))
    summed = scratch.cut(summed)
    scratch.drop(ranged)
    large = summed.where("not small and not right").groupBy("node").agg(F.sum("bytes").alias("large"))  # at most one row a shard
    summed_up = summed.join(F.broadcast(large), "node", "left").withColumn("large", F.coalesce("large", F.lit(0)))
    goes = F.when(F.col("small"), middle(F.col("below")) >= 2 * (_dec("all") * F.col("few") - _dec("large") * F.col("m"))).otherwise(F.col("right")) & (F.col("m") > 1)
    summed_up = summed_up.withColumn("goes", goes)
    m = F.when(F.col("m") == 1, 1).when(F.col("goes"), F.col("m") - F.col("few")).otherwise(F.col("few"))
    node = F.col("node") + F.when(F.col("goes"), F.col("few")).otherwise(0)
    return summed, summed_up.select("mark", "n", "bytes", *dims, node.cast("int").alias("node"), m.cast("int").alias("m"))


def _places(slim: DataFrame, scratch: Scratch, shards: int, dims: list[str]) -> DataFrame:
    """doc_id, mark, size, crc, times, shard and slot (the first one of its `times` slots) of each different (doc_id, text)."""
    groups = scratch.cut(slim.groupBy("mark").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[F.min(d).alias(d) for d in dims]))
    of = scratch.cut(group_shards(groups, scratch, shards, dims))
    different = slim.groupBy("doc_id", "mark", "size", "crc").agg(F.count("*").alias("times"))
    different = different.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SLOT_BUCKETS)))
    placed = scratch.cut(join_apart(different, of, "mark"))
    per = placed.groupBy("shard", "bucket").agg(F.sum("times").alias("__n"))
    per = per.select("shard", "bucket", _sum_before("__n", Window.partitionBy("shard").orderBy("bucket")).alias("__n"))
    inside = _sum_before("times", Window.partitionBy("shard", "bucket").orderBy("doc_id", "mark"))
    return placed.withColumn("__inside", inside).join(per, ["shard", "bucket"]).select("doc_id", "mark", "size", "crc", "times", "shard", (F.col("__n") + F.col("__inside")).cast("long").alias("slot"))


def tree_shards(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, shard and slot (gapless from 0 in each shard) for each row.

    Rows of equal texts are in one shard. Shards differ by about 1 / SMALL of their bytes where small texts make up for larger ones, by half a
    group for each level of the tree where these lack, and a group over the mean is alone. Null texts count as empty, and with
    those they are one group; null coordinates come first; a null doc_id is an id like others; a dimension that docs lacks doesn't split;
    repeated rows are so many rows, with slots of their own; whole texts are read whatever their length; an empty table gives an empty
    result; other columns aren't read."""
    scratch = Scratch(docs.sparkSession)
    dims = [f"d{i}" for i in range(len(dimensions))]
    places = _places(scratch.cut(_slim(docs, dimensions)), scratch, shards, dims)
    blocks = places.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {TURNS}"))))
    turn = F.explode(F.sequence(F.col("block") * TURNS, F.least("times", (F.col("block") + 1) * TURNS) - 1)).alias("turn")
    out = blocks.select("doc_id", "size", "crc", "shard", "slot", turn)
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot") + F.col("turn")).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """docs with shard and slot, in place of columns of these names, as tree_shards() has them; rows that agree in doc_id and text take the
    slots of these in any order. Texts are moved once."""
    scratch = Scratch(docs.sparkSession)
    row, turn, shard, slot = fresh(docs, "row", "turn", "shard", "slot")
    places = _places(scratch.cut(_slim(docs, dimensions)), scratch, shards, [f"d{i}" for i in range(len(dimensions))])
    places = places.select(row_digest_of("doc_id", F.col("mark")).alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    met = docs.withColumn(row, row_digest()).join(places, row).withColumn(turn, F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0))) - 1)
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return met.select(*quoted(names), F.col(shard).alias("shard"), (F.col(slot) + F.col(turn)).alias("slot"))
