"""Mixing sources to target weights by a low-discrepancy schedule. Built-in functions only.

Slot i of the schedule takes the point frac(i * golden ratio), which falls into the interval of one source
on the line of all shares; every stretch of slots so has each source very nearly in proportion. A slot's rank among its source's
slots names a block: the source's documents stand in a shuffled order and are cut into blocks of equally
many words, which ranks go through again and again (epochs). No step orders a source in one task: places in
a source and ranks are sums over buckets plus a running sum inside a bucket.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, Scratch, fresh, quoted, row_digest

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: A block has a millionth of all words, and MIN_BLOCK at least.
RESOLUTION, MIN_BLOCK = 1 << 20, 16
#: 2^32 times the golden ratio's fraction.
GOLDEN = 2654435769
CELL_BITS, RUN_BITS = 10, 12


class Mixture(NamedTuple):
    docs: DataFrame  # row (of common.row_digest), doc_id, source, src, size, start (of its words in the source's shuffled order)
    sources: DataFrame  # src, source_size, target and what follows from them
    pieces: DataFrame  # slot, src, epoch, block, start, doc_id, size, words: what a slot takes of a document


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(column: str = "source") -> Column:
    """Never null, in code point order, null last."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), column))


def _running(df: DataFrame, groups: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows before each one in its group: by buckets first, then inside a bucket."""
    per = df.groupBy(*groups, bucket).agg(F.sum(value).alias("__sum"))
    before = per.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__inside", inside).join(before, [*groups, bucket]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes: src, source_size. Adds target: share of all words by weight, none above cap times its source.

    Sources stand in order of cap / weight; those before the first that stays under the common level are capped."""
    every = Window.partitionBy()
    turn = F.pmod(F.row_number().over(Window.orderBy("src")) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), turn + 1)
    df = sizes.select("src", "source_size", w.alias("w")).withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("w"))
    earlier = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    df = df.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(earlier), F.lit(0))))
    df = df.withColumn("capped", F.col("ratio") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    target = F.when(F.col("capped"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("w") * level)
    return df.select("src", "source_size", target.alias("target"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 0) -> Mixture:
    """The mix of all documents. docs: doc_id, text, source; a size is the number of words.

    Null and empty texts have size 0 and are in no slot. A null source is a source, the last; a null
    doc_id is an id like others. Repeated rows are so many documents, side by side in the order. An empty table, or one without words, gives no
    slots. Other columns aren't read. The result depends on the rows alone, not on their order or partitions."""
    scratch = Scratch(docs.sparkSession)
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    slim = docs.select(row_digest().alias("row"), F.col("doc_id").cast("long"), "source", source_key().alias("src"), word_count().alias("size"), mark.alias("mark"))
    slim = scratch.cut(slim.withColumn("bucket", F.substring("mark", 1, 3)))
    sizes = slim.groupBy("src").agg(F.sum("size").alias("source_size"))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(MIN_BLOCK, total // RESOLUTION)
    placed = scratch.cut(_running(slim, ["src"], "bucket", ["mark", "doc_id", "size", "row"], F.col("size"), "start").select("row", "doc_id", "source", "src", "size", "start"))

    # words wanted of a source, its blocks, and the slots for them
    per = targets(sizes, weights, share, cap).withColumn("want", F.floor("target")).withColumn("blocks", F.ceil(F.col("source_size") / block))
    epochs = F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(F.lit(0))
    per = per.withColumn("slots", epochs * F.col("blocks") + F.ceil((F.col("want") - epochs * F.col("source_size")) / block))
    every = Window.partitionBy()
    upto = F.sum("slots").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("all", F.sum("slots").over(every)).withColumn("upto", upto)
    scale = lambda c: F.floor(c.cast("double") * 4294967296.0 / F.greatest("all", F.lit(1)))
    per = scratch.cut(per.withColumn("low", scale(F.col("upto") - F.col("slots"))).withColumn("high", scale(F.col("upto"))))

    n = per.agg(F.coalesce(F.max("all"), F.lit(0))).first()[0]
    n += n // 64 + 64 if n else 0
    shift = 32 - CELL_BITS
    slot = docs.sparkSession.range(n).select(F.col("id").alias("slot"), F.expr(f"(id * {GOLDEN}) % 4294967296").alias("x"))
    slot = slot.withColumn("cell", F.shiftright("x", shift))
    cells = per.where("slots > 0 and high > low").select("src", "low", "high", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"))
    drawn = slot.join(cells, "cell").where("x >= low and x < high").select("slot", "src", F.shiftright("slot", RUN_BITS).alias("run"))
    ranked = _running(drawn, ["src"], "run", ["slot"], F.lit(1), "rank").select("slot", "src", "rank")
    ranked = scratch.cut(ranked.join(per.select("src", "slots"), "src").where("rank < slots").drop("slots"))
    # a source whose interval holds few points may lack its last slots: they follow at the end
    had = ranked.groupBy("src").agg(F.count("*").alias("had"))
    short = per.join(had, "src", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    rest = short.select("src", F.col("upto").alias("u"), "slots", F.explode(F.sequence("had", F.col("slots") - 1)).alias("rank"))
    rest = rest.select((F.lit(n) + F.col("u") - F.col("slots") + F.col("rank")).alias("slot"), "src", "rank")
    schedule = ranked.unionByName(rest).join(per.select("src", "blocks", "source_size", "want"), "src")
    schedule = schedule.withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    end = F.least((F.col("block") + 1) * block, "source_size", F.col("want") - F.col("epoch") * F.col("source_size"))
    schedule = schedule.select("slot", "src", "epoch", "block", end.alias("end"))

    held = placed.where("size > 0").select("doc_id", "src", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    words = F.least(F.col("start") + F.col("size"), "end") - F.greatest("start", F.col("block") * block)
    pieces = schedule.join(held, ["src", "block"]).select("slot", "src", "epoch", "block", "start", "doc_id", "size", words.alias("words")).where("words > 0")
    return Mixture(placed, per, pieces)


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document; see mixture()."""
    mix = mixture(docs, **how)
    got = mix.pieces.groupBy("src", "start").agg(F.sum("words").alias("taken"))
    of = mix.docs.withColumn("__at", F.when(F.col("size") > 0, F.col("start"))).join(got.withColumnRenamed("start", "__at"), ["src", "__at"], "left")
    return of.join(mix.sources.select("src", "source_size", "target"), "src").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, with the columns of docs: one row for each epoch that takes at least half of a document's words.

    Each row comes by its own text, whatever its id; of rows that agree in id, text and source each comes as often as the one of them that comes most often.
    Null ids and sources are ids and sources like others; an empty table gives an empty one."""
    mix = mixture(docs, **how)
    row, src, times, turn = fresh(docs, "row", "src", "times", "turn")
    turns = mix.pieces.groupBy("src", "start", "size", "epoch").agg(F.sum("words").alias("words")).where("2 * words >= size")
    per = turns.groupBy("src", "start").agg(F.count("*").cast("int").alias("n")).join(mix.docs.where("size > 0").select("src", "start", "row"), ["src", "start"])
    per = per.groupBy(F.col("row").alias(row), F.col("src").alias(src)).agg(F.max("n").alias(times))
    met = docs.withColumn(row, row_digest()).withColumn(src, source_key()).join(per, [row, src])
    return met.withColumn(turn, F.explode(F.sequence(F.lit(1), times))).select(*quoted(docs.columns))
