"""Prices by time: for each row the last price at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket of times, and buckets of a group of buckets.
BUCKET, GROUP = 86_400, 1024


def _carried(edges: DataFrame, key: str, value: str, within: str | None) -> DataFrame:
    """Adds before: the last value that isn't null of the rows before each one, in the order of key, within groups if some are given."""
    order = (Window.partitionBy(within) if within else Window).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return edges.withColumn("before", F.last(value, ignorenulls=True).over(order))


def with_price(rows: DataFrame, prices: DataFrame, time: str = "timestamp", name: str = "price", bucket: int = BUCKET) -> DataFrame:
    """rows with the price that holds at their time, null before the first one.

    prices: time (seconds), price. Rows and prices meet in buckets of times, where a window carries prices on to later rows. What a bucket begins
    with comes from the last price of the buckets before it: over one row a bucket, by groups of GROUP buckets, and over one row a group. So no window has
    all rows in one partition. Of several prices at one time the highest counts; rows without a time get none; rows that repeat stay."""
    at, place = f"__{time}_bucket", F.floor(F.col(time) / bucket)
    cut = prices.where("time IS NOT NULL AND price IS NOT NULL").select(F.col("time").cast("long").alias("time"), "price", F.floor(F.col("time") / bucket).alias("at"))
    closing = cut.groupBy("at").agg(F.max(F.struct("time", "price"))["price"].alias("closing"))  # a row a bucket
    known = closing.union(rows.select(place.alias("at"), F.lit(None).cast(prices.schema["price"].dataType)).where("at IS NOT NULL").distinct())
    edges = known.groupBy("at").agg(F.max("closing").alias("closing")).withColumn("part", F.floor(F.col("at") / GROUP))
    parts = edges.where("closing IS NOT NULL").groupBy("part").agg(F.max_by("closing", "at").alias("closing"))
    parts = _carried(parts.union(edges.select("part", F.lit(None).cast(prices.schema["price"].dataType)).distinct()).groupBy("part").agg(F.max("closing").alias("closing")), "part", "closing", None)
    begins = _carried(edges, "at", "closing", "part").join(parts.select("part", F.col("before").alias("earlier")), "part")
    begins = begins.select("at", F.coalesce("before", "earlier").alias("price")).where("price IS NOT NULL")
    # a price, or what a bucket begins with, comes before the rows of its time
    changes = cut.select("at", "time", F.lit(1).alias("kind"), "price").union(begins.select("at", (F.col("at") * bucket).alias("time"), F.lit(0), "price"))
    fields = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    events = rows.select(place.alias("at"), F.col(time).cast("long").alias("time"), F.lit(2).alias("kind"), F.lit(None).cast(prices.schema["price"].dataType).alias("price"), fields.alias(at))
    empty = F.lit(None).cast(events.schema[at].dataType).alias(at)
    order = Window.partitionBy("at").orderBy("time", "kind", "price").rowsBetween(Window.unboundedPreceding, 0)
    timed = events.where("at IS NOT NULL").union(changes.select("at", "time", "kind", "price", empty))
    found = timed.withColumn("price", F.last("price", ignorenulls=True).over(order)).where("kind = 2").union(events.where("at IS NULL").select("at", "time", "kind", "price", at))
    return found.select(f"{at}.*", F.col("price").alias(name))
