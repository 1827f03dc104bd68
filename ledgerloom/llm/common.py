"""Helpers shared by the text operators: shared storage, lineage cuts, sizing and packing."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.storage import shared_dir

#: Words are maximal runs of bytes other than ASCII white space, which is what bytes.split() gives.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null document id wherever ids are compared: it is larger than any other.
NO_ID = 2**63 - 1


class Scratch:
    """Written tables that cut lineage. A table that a later one replaces can be dropped; what is left goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame, compression: str = "none") -> DataFrame:
        """Write df and read it back, so that what follows neither recomputes it nor depends on an executor's files.

        Narrow tables are read several times in a row: uncompressed, they need no buffers outside the heap,
        which pile up until a collection. Give a codec for tables with texts."""
        self.count += 1
        at = f"{self.root}/{self.count}"
        df.write.option("compression", compression).parquet(at)
        if self.count == 1:
            fs, path = self._fs(self.root)
            fs.deleteOnExit(path)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._ledgerloom_at = at
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that nothing reads any more."""
        if at := getattr(df, "_ledgerloom_at", None):
            fs, path = self._fs(at)
            fs.delete(path, True)

    def _fs(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def known_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def row_digest(key: str = "doc_id", column: str = "text") -> Column:
    """A digest of an id and a text, which rows have in common only if they agree in both. A null text counts as empty."""
    return row_digest_of(key, F.unhex(F.md5(text_bytes(column))))


def row_digest_of(key: str, mark: Column) -> Column:
    """row_digest() by the 16 bytes of the text's MD5."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(key).cast("long").cast("string"), F.lit("none")).cast("binary"), mark)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one like it that df has no column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}") in taken:
            pass
        out.append(name)
        taken.add(name)
    return out


#: A key with one in so many of all rows is joined apart.
OFTEN = 1024


def join_apart(rows: DataFrame, per: DataFrame, key: str | list[str], often: int | None = None) -> DataFrame:
    """Inner join with a written table that has one row a key and, as n, how many rows have that key; n is left out.

    Keys with at least one in OFTEN of all rows, of which there can't be more than that number, are joined by broadcast, so
    that no task gets all rows of one of them."""
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") * (often or OFTEN) >= F.lit(total)
    near = rows.join(F.broadcast(per.where(heavy).drop("n")), key)
    far = rows.join(F.broadcast(per.where(heavy).select(key)), key, "left_anti").join(per.where(~heavy).drop("n"), key)
    return near.unionByName(far)


def quoted(names: list[str]) -> list[Column]:
    """Columns by their names, whatever marks these have in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about so many bytes, so that what a task holds doesn't depend on the length of rows; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        cuts = runs_of(part).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            yield batch.slice(a, b - a)


def trim() -> None:
    """Give memory that a task has freed back to the system. Workers live on for later tasks and stages, beside an executor's heap that doesn't shrink either."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of a task, after which it gives back what it has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return run


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def parts_for(spark: SparkSession, n_bytes: int, part_bytes: int) -> int:
    """How many parts to deal texts into: parts of part_bytes, and at least one for each shuffle partition.

    Every part talks to every bucket, so parts grow to 256 MB before their number passes some thousands."""
    size = min(max(part_bytes, n_bytes // 4096), 256 << 20)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // size), 1)


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, values[1:] != values[:-1]))


def find(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each key its place in the sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def planes(values: np.ndarray) -> bytes:
    """Fixed-size records as bytes, all first bytes before all second ones, which compresses well."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, kind: np.dtype | str) -> np.ndarray:
    kind = np.dtype(kind)
    n = len(data) // kind.itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)
