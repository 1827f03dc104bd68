"""Which blocks are there: ranges, gaps, coverage of files, statistics, retention."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.display import utc_time
from ledgerloom.storage import BUCKET


class Range(NamedTuple):
    first: int
    last: int


def head(blocks: DataFrame) -> int | None:
    return blocks.agg(F.max("block_number")).first()[0]


def parse_range(text: str, latest: int, max_size: int | None = None) -> Range:
    """`N`, `N:M`, `latest`, `N:latest` or `N:` (the last N blocks) as a range; raises ValueError for anything else."""
    if text == "latest":
        out = Range(latest, latest)
    elif m := re.fullmatch(r"(\d+):?(latest)?", text):
        n = int(m[1])
        if ":" in text:
            if n == 0:
                raise ValueError("a range of the last 0 blocks is empty")
            out = Range(max(0, latest - n + 1), latest)
        elif m[2]:
            raise ValueError(f"not a block range: {text}")
        else:
            out = Range(n, n)
    elif m := re.fullmatch(r"(\d+):(\d+)", text):
        out = Range(int(m[1]), int(m[2]))
    else:
        raise ValueError(f"not a block range: {text}")
    if out.first > out.last:
        raise ValueError(f"the range starts after its end: {text}")
    if out.last > latest:
        raise ValueError(f"the range ends after the latest block {latest}: {text}")
    if max_size is not None and out.last - out.first + 1 > max_size:
        raise ValueError(f"the range has more than {max_size} blocks: {text}")
    return out


def in_range(df: DataFrame, r: Range) -> DataFrame:
    return df.where(F.col("block_number").between(r.first, r.last))


def missing_blocks(blocks: DataFrame, r: Range) -> DataFrame:
    """block_number of each block of the range that isn't there."""
    spark = blocks.sparkSession
    return spark.range(r.first, r.last + 1).select(F.col("id").alias("block_number")).join(in_range(blocks, r).select("block_number"), "block_number", "left_anti")


def contiguous_runs(numbers: DataFrame, column: str = "block_number", bucket: int = 1 << 16) -> DataFrame:
    """first, last of each run of consecutive numbers. Runs are made within buckets; those that meet at a bucket's edge are joined after, over edges alone."""
    n = F.col(column)
    inside = Window.partitionBy("__bucket").orderBy(column)
    parts = numbers.select(n, F.floor(n / bucket).alias("__bucket")).distinct().withColumn("__run", n - F.row_number().over(inside))
    parts = parts.groupBy("__bucket", "__run").agg(F.min(column).alias("first"), F.max(column).alias("last"))
    edge = (F.pmod(F.col("first"), F.lit(bucket)) == 0) | (F.pmod(F.col("last") + 1, F.lit(bucket)) == 0)
    whole = parts.where(~edge).select("first", "last")
    order = Window.orderBy("first")  # at most two rows a bucket
    edges = parts.where(edge).withColumn("__new", F.coalesce((F.lag("last").over(order) + 1 != F.col("first")).cast("int"), F.lit(1)))
    edges = edges.withColumn("__group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return whole.union(edges.groupBy("__group").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last"))


def uncovered(files: DataFrame, r: Range) -> DataFrame:
    """first, last of each part of the range that no file (start, end) covers."""
    order = Window.orderBy("start", "end")  # a row a file
    inside = files.where((F.col("end") >= r.first) & (F.col("start") <= r.last)).select("start", "end")
    edges = files.sparkSession.createDataFrame([(r.first - 1, r.first - 1), (r.last + 1, r.last + 1)], "start long, end long")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = inside.unionByName(edges).select((reach + 1).alias("first"), (F.col("start") - 1).alias("last"))
    return gaps.where("first <= last").select(F.greatest("first", F.lit(r.first)).alias("first"), F.least("last", F.lit(r.last)).alias("last"))


def run_summary(blocks: DataFrame, r: Range) -> DataFrame:
    """first, last, total, new_blocks, cached_blocks of a range before it is indexed."""
    total = r.last - r.first + 1
    cached = in_range(blocks, r).agg(F.countDistinct("block_number").alias("cached"))
    return cached.select(F.lit(r.first).alias("first"), F.lit(r.last).alias("last"), F.lit(total).alias("total"), (total - F.col("cached")).alias("new_blocks"), F.col("cached").alias("cached_blocks"))


def gap_fill(blocks: DataFrame, keep: int | None = None) -> DataFrame:
    """first, last of the runs of missing blocks between the first stored one, or the oldest kept one, and the last."""
    low, high = blocks.agg(F.min("block_number"), F.max("block_number")).first()
    if low is None:
        return blocks.sparkSession.createDataFrame([], "first long, last long")
    low = low if keep is None else max(low, high + 1 - keep)
    return contiguous_runs(missing_blocks(blocks, Range(low, high)))


def files_of_gaps(files: DataFrame, runs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The files (path, start, end) that have blocks of some runs (first, last). Both are cut into buckets of blocks and joined by these."""
    parts = lambda df, a, b: df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    met = parts(files, "start", "end").join(parts(runs.select("first", "last"), "first", "last"), "__bucket").where("start <= last AND end >= first")
    return met.select(*files.columns).distinct()


def statistics(transactions: DataFrame, logs: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: counts, first and last block with their times, missing blocks."""
    b = blocks.agg(F.min("block_number").alias("min_block"), F.max("block_number").alias("max_block"), F.min("timestamp").alias("__low"), F.max("timestamp").alias("__high"), F.count("*").alias("total_blocks"))
    b = b.select("min_block", utc_time("__low").alias("min_block_time"), "max_block", utc_time("__high").alias("max_block_time"), "total_blocks", F.coalesce(F.col("max_block") - F.col("min_block") + 1 - F.col("total_blocks"), F.lit(0)).alias("missing_blocks"))
    return b.crossJoin(logs.agg(F.count("*").alias("total_logs"))).crossJoin(transactions.agg(F.count("*").alias("total_txs")))  # one row each


def stored_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of the Parquet files in a folder, from their listing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def cutoff(blocks: DataFrame, keep: int) -> int | None:
    """Blocks below this one aren't among the last `keep`; None for an empty table."""
    latest = head(blocks)
    return None if latest is None else max(0, latest + 1 - keep)


def retention(tables: dict[str, DataFrame], keep: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the blocks below the cutoff, and one row: latest, cutoff and the purged rows of each table."""
    spark = tables["blocks"].sparkSession
    latest = head(tables["blocks"])
    at = None if latest is None else max(0, latest + 1 - keep)
    if at is None:
        return tables, spark.createDataFrame([], "latest long, cutoff long, " + ", ".join(f"purged_{t} long" for t in tables))
    report = spark.range(1).select(F.lit(latest).alias("latest"), F.lit(at).alias("cutoff"))
    for name, df in tables.items():
        report = report.crossJoin(df.where(F.col("block_number") < at).agg(F.count("*").alias(f"purged_{name}")))  # one row each
    return {name: df.where(F.col("block_number") >= at) for name, df in tables.items()}, report


def prunable(files: DataFrame, blocks: DataFrame, r: Range, bucket: int = BUCKET) -> DataFrame:
    """Files that overlap the range and whose blocks are all stored. A range join by buckets of block numbers."""
    near = files.where((F.col("end") >= r.first) & (F.col("start") <= r.last))
    cut = near.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    have = blocks.select("block_number", F.floor(F.col("block_number") / bucket).alias("__bucket")).distinct()
    hits = cut.join(have, "__bucket").where("block_number BETWEEN start AND end").groupBy("path").agg(F.count("*").alias("__n"))
    return near.join(hits, "path").where("__n = end - start + 1").drop("__n")
