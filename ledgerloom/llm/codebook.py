"""Vector codes by parts: vectors become small integers, are cut into equal parts, and each part becomes the number of its nearest codebook entry.

The nearest entry is found by equal-average search. Entries are sorted by the sum of their components; the squared gap
between the sums of a part and an entry is at most their squared distance times their dimension. So the search
starts at the part's own sum, goes outward to the entry with the next smaller gap on either side, and ends when a squared gap
exceeds the best distance times the dimension; only entries that can neither win nor tie are left out. Codebooks, which have a
fixed size, are trained by rounds: the tasks sum the parts of each entry, one row an entry and task, and the driver divides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, join_apart, known_id

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components are held within this, so that squared distances of up to 256 components stay exact; it stands for floats over a million.
MOST = 1 << 26
#: Vectors that are searched at once.
BLOCK = 4096


def finite(column: str = "embedding") -> Column:
    """Whether a vector is there and holds neither nulls nor what isn't finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & ~F.exists(column, bad)


def scaled(column: str = "embedding") -> Column:
    """Whole numbers for the components."""
    return F.transform(column, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))


class Codebook:
    """entries: for each part its entries, one row each; a part's index is that of its first axis."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        sums = self.entries.sum(axis=2)
        self.order = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.order, axis=1)

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part of each vector (vectors, parts, components) its nearest entry, ties to the lower index, and the squared distance."""
        count, parts, width = vectors.shape
        size = self.entries.shape[1]
        flat, part = vectors.reshape(-1, width), np.tile(np.arange(parts), count)
        own = flat.sum(axis=1)
        high = np.empty(len(own), np.int64)
        for p in range(parts):
            high[p::parts] = np.searchsorted(self.sums[p], own[p::parts])
        low = high - 1
        best, at = np.full(len(own), np.iinfo(np.int64).max // 2 // width), np.full(len(own), size)
        far = np.int64(1) << 40
        live = np.arange(len(own))
        while len(live):
            p, a, b, s = part[live], low[live], high[live], own[live]
            below = np.where(a >= 0, s - self.sums[p, np.maximum(a, 0)], far)
            above = np.where(b < size, self.sums[p, np.minimum(b, size - 1)] - s, far)
            down = below <= above
            gap = np.where(down, below, above)
            go = (gap < far) & (gap * gap <= width * best[live])
            live, p, down = live[go], p[go], down[go]
            entry = self.order[p, np.where(down, a[go], b[go])]
            apart = flat[live] - self.entries[p, entry]
            distance = np.einsum("ij,ij->i", apart, apart)
            wins = (distance < best[live]) | ((distance == best[live]) & (entry < at[live]))
            best[live[wins]], at[live[wins]] = distance[wins], entry[wins]
            low[live] -= down
            high[live] += ~down
        return at.reshape(count, parts), best.reshape(count, parts)

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebook:
        """Each entry at the floored mean of its parts; sums: their number and their sums, by part and entry. Entries without parts stay."""
        entries = self.entries.copy()
        for (part, entry), (n, total) in sums.items():
            entries[part, entry] = [x // n for x in total]
        return Codebook(entries)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _cut(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Vectors by parts; those that are too short end in zeros."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(column), parts * width), np.int64)
    values = column.values.to_numpy()[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out.reshape(len(column), parts, width)


def _assigned(batches: Iterator[pa.RecordBatch], book: Codebook, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    parts, _, width = book.entries.shape
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            some = batch.slice(k, BLOCK)
            vectors = _cut(some.column(at), parts, width)
            yield some, vectors, *book.search(vectors)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebook | None:
    """The codebook of a table of vec_id and q (whole numbers), started from the vectors with the smallest ids; None without vectors.

    The driver gets `entries` vectors, and a row an entry and part in each round."""
    first = vectors.orderBy(known_id("vec_id"), "q").limit(entries).collect()
    if not first:
        return None
    longest = vectors.agg(F.max(F.size("q"))).first()[0]
    width = max(1, -(-longest // parts))
    start = np.zeros((len(first), parts * width), np.int64)
    for row, x in zip(start, first, strict=True):
        row[: len(x.q)] = x.q
    book = Codebook(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    names = [f"s{i}" for i in range(width)]
    for _ in range(rounds):

        def work(batches: Iterator[pa.RecordBatch], book: Codebook = book) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts * len(first), width + 1), np.int64)
            for _, v, at, _ in _assigned(batches, book, 0):
                own = (at + np.arange(parts) * len(first)).ravel()
                np.add.at(sums, own, np.column_stack([np.ones(len(own), np.int64), v.reshape(-1, width)]))
            some = np.flatnonzero(sums[:, 0])
            yield pa.record_batch([pa.array(some), *(pa.array(sums[some, i].copy()) for i in range(width + 1))], ["entry", "n", *names])

        each = vectors.select("q").mapInArrow(work, "entry long, n long, " + ", ".join(f"{c} long" for c in names))
        total = each.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names)).collect()
        book = book.moved({divmod(x.entry, len(first)): (x.n, [int(x[c]) for c in names]) for x in total})
    return book


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of vectors.

    rows: vec_id, embedding, label. Returns for each vector vec_id, code (two hex digits a part), error (squared distances to the entries, summed over parts),
    label_error (error summed over equal labels, nulls together) and codebooks_sha256 (of all entries' components by part, entry and place, joined by commas).
    Components are floor(256 x), held within MOST. Rows whose vector is null or holds nulls or what isn't finite are left out; vectors of other sizes than the largest, the empty one
    among them, end in zeros, as does the last part. With fewer vectors than entries each of them is an entry. Ties between entries go to the lower
    index, and between equal ids to the smaller vector; a null id is the largest and stays null; repeated rows are rows like others; an empty table gives an empty result; other columns aren't read."""
    if not 1 <= entries <= 256:
        raise ValueError("entries have two hex digits")
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    kept = rows.where(finite()).select(F.col("vec_id").cast("long").alias("vec_id"), "label", scaled().alias("q"))
    book = train(kept.select("vec_id", "q"), parts, entries, rounds)
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if book is None:
        return spark.createDataFrame([], schema).drop("label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, at, distance in _assigned(batches, book, 2):
            codes = at.astype(np.uint8).tobytes().hex()
            codes = [codes[k : k + 2 * parts] for k in range(0, len(codes), 2 * parts)]
            yield pa.record_batch([some.column(0), some.column(1), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))], ["vec_id", "label", "code", "error"])

    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    coded = kept.mapInArrow(work, schema.split(", label_error")[0])
    coded = scratch.cut(coded.select("vec_id", "code", "error", key))
    per = scratch.cut(coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    out = join_apart(coded, per, "key")
    return out.select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
