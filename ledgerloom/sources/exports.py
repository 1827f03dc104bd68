"""Reading exports: Parquet files named network__dataset__start_to_end.parquet, signature files, chain lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schema

NAME = r"([^/]+)__([a-z_]+)__(\d+)_to_(\d+)\.parquet$"
EXPORTS = {"transactions": schema.TX_EXPORT, "logs": schema.LOG_EXPORT, "blocks": schema.BLOCK_EXPORT}


def files_of(paths: DataFrame) -> DataFrame:
    """path -> path, network, dataset, start, end; names of another form are left out."""
    parts = [F.regexp_extract("path", NAME, i) for i in range(1, 5)]
    return paths.where(F.col("path").rlike(NAME)).select("path", parts[0].alias("network"), parts[1].alias("dataset"), parts[2].cast("long").alias("start"), parts[3].cast("long").alias("end"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The export files of a folder with their block ranges and sizes; only names and sizes are read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files_of(listed).join(listed, "path")


def overlapping(files: DataFrame, first: int | Column, last: int | Column) -> DataFrame:
    """Files with blocks in [first, last]."""
    return files.where((F.col("end") >= first) & (F.col("start") <= last))


def read_export(spark: SparkSession, dataset: str, paths: list[str], first: int | None = None, last: int | None = None) -> DataFrame:
    """An export's rows, by column name; a block range is pushed down to the files."""
    df = spark.read.schema(EXPORTS[dataset]).parquet(*paths)
    if first is not None:
        df = df.where(F.col("block_number") >= first)
    return df if last is None else df.where(F.col("block_number") <= last)


def read_range(spark: SparkSession, folder: str, dataset: str, first: int, last: int, network: str | None = None) -> DataFrame:
    """An export's rows with blocks in [first, last], from the files whose names say that they have some; of one network, if one is given."""
    named = manifest(spark, folder).where(F.col("dataset") == dataset)
    named = named if network is None else named.where(F.col("network") == network)
    files = overlapping(named, first, last).select("path").collect()  # one row a file of the range
    paths = sorted(r["path"] for r in files)
    return read_export(spark, dataset, paths, first, last) if paths else spark.createDataFrame([], EXPORTS[dataset])


SIGNATURES = T.StructType([T.StructField("signature_hash_4", T.BinaryType()), T.StructField("signature_hash_32", T.BinaryType()), T.StructField("signature", T.StringType())])
COMPILED = T.StructType([T.StructField("signature_hash_32", T.BinaryType()), T.StructField("signature_type", T.StringType())])


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGNATURES).parquet(path).dropna()


def read_compiled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPILED).parquet(path).dropna()


CHAIN = "chainId long, name string, chain string, shortName string, rpc array<string>, nativeCurrency struct<name: string, symbol: string, decimals: int>, explorers array<variant>"


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of chains: id, name, short_name, currency_symbol, explorers (urls, given as text or as objects with url)."""
    url = lambda e: F.coalesce(F.try_variant_get(e, "$.url", "string"), F.try_variant_get(e, "$", "string"))
    df = spark.read.schema(CHAIN).option("multiLine", "true").json(path)
    urls = F.filter(F.transform(F.coalesce("explorers", F.array().cast("array<variant>")), url), lambda u: u.isNotNull())
    return df.select(F.col("chainId").alias("id"), "name", F.coalesce("shortName", "chain").alias("short_name"), F.col("nativeCurrency.symbol").alias("currency_symbol"), urls.alias("explorers"))
