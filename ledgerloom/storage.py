"""The folder that driver and executors share, and tables in buckets whose versions change at once."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without that setting gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.ledgerloom.shared", "")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.ledgerloom.shared", at)
    return at.rstrip("/")


#: Blocks of one bucket of the stored tables.
BUCKET = 1000
#: Buckets whose files a task writes side by side. Rows of any more are sorted by bucket first; without it all are, and whole files spill.
WRITERS, OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters", 4


class Versions:
    """What a store consists of: a small JSON file for each version, of which the highest counts.

    A version is written beside the others and then renamed, so a reader finds the old one or the new one. There is one writer at a time: a second
    one that makes the same version fails. Folders that no version names yet aren't read, and a later attempt overwrites them."""

    KEEP = 3

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self.path(f"{self.root}/_versions")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def read(self) -> tuple[int, dict]:
        """The newest version: its number and its content; 0 and nothing for a new store."""
        if not (numbers := self._numbers()):
            return 0, {}
        text = self.spark.read.text(f"{self.root}/_versions/{numbers[-1]:012d}.json", wholetext=True).first()[0]
        return numbers[-1], json.loads(text)

    def commit(self, number: int, state: dict) -> None:
        """Make a version the newest one; another writer's version of that number raises."""
        fs, staged = self.path(f"{self.root}/_versions/_{number:012d}-{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(json.dumps(state).encode())
        out.close()
        if not fs.rename(staged, self.path(f"{self.root}/_versions/{number:012d}.json")[1]):
            fs.delete(staged, False)
            raise RuntimeError(f"{self.root}: another writer made version {number}")
        for old in self._numbers()[: -self.KEEP]:
            fs.delete(self.path(f"{self.root}/_versions/{old:012d}.json")[1], False)


class BucketTable:
    """A table as Parquet, partitioned by chain, bucket of blocks and generation.

    A bucket's rows are those of one generation: the table's own, or a later one in which the bucket was written anew. The state of a Versions says which."""

    def __init__(self, versions: Versions, key: str, kinds: T.StructType):
        self.versions, self.key, self.kinds = versions, key, kinds
        self.folder = f"{versions.root}/{key}"

    def _moved(self, state: dict) -> dict[str, int]:
        return state.get("gens", {}).get(self.key, {})

    def _base(self, state: dict) -> int:
        return state.get("tables", {}).get(self.key, {}).get("gen", 0)

    def read(self, state: dict, r: tuple[int, int] | None = None, chain: int | None = None) -> DataFrame:
        """The rows, with chain_id, of a version; a block range and a chain prune folders."""
        fs, path = self.versions.path(self.folder)
        spark = self.versions.spark
        if not fs.exists(path):
            return spark.createDataFrame([], T.StructType([*self.kinds.fields, T.StructField("chain_id", T.IntegerType())]))
        df = spark.read.schema(T.StructType([*self.kinds.fields]).add("chain_id", T.IntegerType()).add("bucket", T.LongType()).add("gen", T.LongType())).parquet(self.folder)
        moved, place = self._moved(state), F.concat_ws("/", "chain_id", "bucket")
        own = F.col("gen") == self._base(state)
        if moved:
            own = (own & ~place.isin(list(moved))) | F.concat_ws("/", "chain_id", "bucket", "gen").isin([f"{k}/{g}" for k, g in moved.items()])
        df = df.where(own)
        for c, first in state.get("floor", {}).items():
            df = df.where((F.col("chain_id") != int(c)) | ((F.col("bucket") >= first // BUCKET) & (F.col("block_number") >= first)))
        if chain is not None:
            df = df.where(F.col("chain_id") == chain)
        if r is not None:
            df = df.where(F.col("bucket").between(r[0] // BUCKET, r[1] // BUCKET) & F.col("block_number").between(*r))
        return df.select(*self.kinds.fieldNames(), "chain_id")

    def _write(self, rows: DataFrame, chain: int, gen: Column, mode: str) -> None:
        bucket = F.floor(F.col("block_number") / BUCKET)
        placed = rows.select(*self.kinds.fieldNames(), F.lit(chain).alias("chain_id"), bucket.alias("bucket")).withColumn("gen", gen)
        conf = rows.sparkSession.conf
        was = conf.get(WRITERS)
        conf.set(WRITERS, OPEN_FILES)
        try:
            placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("chain_id", "bucket", "gen").parquet(self.folder)
        finally:
            conf.set(WRITERS, was)

    def append(self, state: dict, rows: DataFrame, chain: int, r: tuple[int, int]) -> None:
        """Add rows, of blocks in r, to the generations that count."""
        gen = F.lit(self._base(state))
        for place, g in self._moved(state).items():
            c, bucket = map(int, place.split("/"))
            if c == chain and r[0] // BUCKET <= bucket <= r[1] // BUCKET:
                gen = F.when(F.col("bucket") == bucket, g).otherwise(gen)
        self._write(rows, chain, gen, "append")

    def write(self, rows: DataFrame, chain: int, gen: int) -> None:
        """Write rows as a generation; what an attempt before left of their buckets is overwritten."""
        self._write(rows, chain, F.lit(gen), "overwrite")

    def moved(self, state: dict, chain: int, buckets: list[int], gen: int) -> dict:
        """The state once some buckets are those of a generation."""
        gens = {**state.get("gens", {}), self.key: {**self._moved(state), **{f"{chain}/{b}": gen for b in buckets}}}
        return {**state, "gens": gens}

    def _folders(self, path, what: str) -> dict:
        """number -> folder of those named what=number."""
        fs = self.versions.path(self.folder)[0]
        return {int(m[1]): x.getPath() for x in fs.listStatus(path) if (m := re.fullmatch(rf"{what}=(\d+)", x.getPath().getName()))}

    def clear(self, chain: int, gen: int) -> None:
        """Delete what an attempt that no version names has left of a generation."""
        fs, path = self.versions.path(f"{self.folder}/chain_id={chain}")
        if fs.exists(path):
            for bucket in self._folders(path, "bucket").values():
                if old := self._folders(bucket, "gen").get(gen):
                    fs.delete(old, True)

    def sweep(self, state: dict) -> None:
        """Delete folders that no version from this one on reads: buckets below a floor, generations that others replaced."""
        fs, top = self.versions.path(self.folder)
        if not fs.exists(top):
            return
        moved, base = self._moved(state), self._base(state)
        for chain, at in self._folders(top, "chain_id").items():
            first = state.get("floor", {}).get(str(chain), 0)
            for bucket, path in self._folders(at, "bucket").items():
                if bucket < first // BUCKET:
                    fs.delete(path, True)
                elif f"{chain}/{bucket}" in moved or base:
                    for gen, old in self._folders(path, "gen").items():
                        if gen < moved.get(f"{chain}/{bucket}", base):
                            fs.delete(old, True)
