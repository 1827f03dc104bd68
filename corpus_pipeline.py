"""A training-text pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import Scratch
from ledgerloom.llm.decontaminate import decontaminated
from ledgerloom.llm.jaccard import keep_first_similar
from ledgerloom.llm.kdshard import sharded
from ledgerloom.llm.mixing import mixed
from ledgerloom.llm.repetition import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the repetition rules go, each row by its own text. Null and empty texts fail; whole texts count whatever their length; rows that
    repeat and rows without an id are judged like others; an empty table gives an empty one; all columns stay, whatever they are called."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; ties between rows of one id go by the digest of the text, rows that agree in
    both are one. A row without an id comes after those with one; texts without words, null ones among them, are one group; whole texts are compared; an
    empty table gives an empty one; other columns stay."""
    return keep_first_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text. Null and empty texts hold none; whole texts are read; repeated rows go or stay together;
    ids may be null; with an empty table or benchmark nothing goes; other columns stay."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice. Null and empty texts have no words, and are taken as such; a null source is
    a source, the last one; ties in the order of documents go by id; an empty table gives an empty one; other columns stay."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its slot there, in place of columns of these names. Equal texts, null ones as empty, share a shard; rows that repeat take slots
    of their own; ids may be null; an empty table gives an empty one; other columns stay."""
    return sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Shingle groups and word suffix arrays aren't SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.cut(docs, "zstd")
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
