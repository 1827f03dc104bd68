"""Near-duplicate documents by shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints within four bits miss most such pairs, as one change of a word in a text of a hundred words
already flips more bits. Here each set of n shingles, in one order for all sets, stands with its first
n - ceil(0.8 n) + 1 shingles: two sets as similar as that have one of these in common. Shingles that many
documents have come last in the order, so few sets meet needlessly; they are counted in an eighth of the documents and told by
bitmaps of a bounded size, whose mistakes cost time at most, no pair. Bitmaps that hold the parity of the shingles of
each cell bound from below how many shingles two sets differ in, which rules most pairs out; the others' sets are
made again from their texts and compared exactly. This goes in two rounds: first with the
smallest set under each shingle, one more and a neighbour in a mixed order, then, where a shingle still has several groups, every set outside
its largest group with those of other groups. A group that is linked already thus costs no pairs within it. In the second round two
sets are compared only if what they have from the shingle on could make them similar, were it the first that they share, as
it is once for every pair: texts that share a common passage, and are otherwise apart, are linked to the smallest or have no partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, by_bytes, fresh, from_planes, frugal, join_apart, known_id, parts_for, planes, quoted, row_digest, runs_of, text_bytes, total_bytes, trim
from ledgerloom.llm.components import components
from ledgerloom.llm import decontaminate
from ledgerloom.llm.simhash import fingerprint, links

SHINGLE = 5
#: One in so many documents is counted; shingles that LEVEL of these have are frequent, and with STEP times as many more so.
COUNTED, LEVEL, STEP = 8, 3, 4
#: Longs of a bitmap.
LONGS = 8
PART_BYTES = 32 << 20
COUNT = np.dtype([("shingle", "<u8"), ("n", "<u4")])
UNDER = np.dtype([("shingle", "<u8"), ("sid", "<i8"), ("n", "<i4"), ("rest", "<i4")])  # rest: shingles of the set from this one on


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; a text of fewer words is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[min(size, len(words)) - 1 :]
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts.tolist(), last.tolist(), strict=False)], np.uint64))


def frequent(docs: DataFrame, scratch: Scratch) -> list[np.ndarray]:
    """For LEVEL, STEP times that and so on up to the largest count a bitmap of the shingles that so many of the counted documents have, by exact counts; each is of a bounded size."""
    buckets = parts_for(docs.sparkSession, total_bytes(docs) // COUNTED, PART_BYTES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            lists = [shingles(t) for t in batch.column(0).to_pylist()]
            own, n = np.unique(np.concatenate(lists), return_counts=True) if lists else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            rows = np.zeros(len(own), COUNT)
            rows["shingle"], rows["n"] = own, n
            bucket = (own >> np.uint64(8)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            s = runs_of(bucket)
            yield pa.record_batch([pa.array(bucket[s], pa.int64()), pa.array([planes(x) for x in np.split(rows, s[1:])] if len(s) else [], pa.binary())], ["bucket", "rows"])

    def add(table: pa.Table) -> pa.Table:
        rows = np.concatenate([from_planes(x.as_py(), COUNT) for x in table.column("rows")])
        rows = rows[np.argsort(rows["shingle"], kind="stable")]
        s = runs_of(rows["shingle"])
        n = np.add.reduceat(rows["n"].astype(np.int64), s) if len(s) else np.zeros(0, np.int64)
        keep = n >= LEVEL
        return pa.table({"hash": rows["shingle"][s][keep].copy().view(np.int64), "n": n[keep]})

    some = docs.where(F.pmod(F.xxhash64(known_id()), F.lit(COUNTED)) == 0).select(text_bytes())
    counts = scratch.cut(some.mapInArrow(frugal(work), "bucket long, rows binary").groupBy("bucket").applyInArrow(add, "hash long, n long"))
    out = []
    level = LEVEL
    while n := counts.where(F.col("n") >= level).count():  # their number grows with the logarithm of the largest count
        out.append(decontaminate.bitmap(counts.where(F.col("n") >= level), n))
        level *= STEP
    return out


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def bitmap(own: np.ndarray) -> np.ndarray:
    """For each of its bits the parity of the number of shingles that fall there."""
    bits = np.bincount((own >> np.uint64(40)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, levels: Broadcast) -> DataFrame:
    """levels: what frequent() gives. row (of common.row_digest), did, fp (the SimHash), sid (a hash of the set), n, prefix (the shingles that it stands with) and the bitmap's longs of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = levels.value
        for batch in by_bytes(batches, 2):
            fps, sids, sizes, prefixes, maps = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                own = shingles(t)
                n = len(own)
                level, often = np.zeros(n, np.int64), np.arange(n)
                for table in tables:
                    often = often[decontaminate.may_be(own[often], table)]
                    level[often] += 1
                order = np.argsort(level, kind="stable")[: n - -(-4 * n // 5) + 1]
                fps.append(fingerprint(t))
                sids.append(set_id(own))
                sizes.append(n)
                prefixes.append(own[order].tobytes())
                maps.append(bitmap(own))
            longs = np.array(maps, np.int64).reshape(-1, LONGS)
            columns = [np.array(fps, np.uint64).view(np.int64), np.array(sids, np.uint64).view(np.int64), *(np.ascontiguousarray(longs[:, i]) for i in range(LONGS))]
            fixed = [pa.array(c, pa.int64()) for c in columns]
            yield pa.record_batch([batch.column(0), batch.column(1), *fixed[:2], pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary()), *fixed[2:]], ["row", "did", "fp", "sid", "n", "prefix", *(f"m{i}" for i in range(LONGS))])

    return docs.select(row_digest().alias("row"), known_id().alias("did"), text_bytes()).mapInArrow(frugal(work), "row binary, did long, fp long, sid long, n int, prefix binary, " + ", ".join(f"m{i} long" for i in range(LONGS)))


def meeting(sets: DataFrame, buckets: int) -> DataFrame:
    """shingle, sid, n, rest, least, low, high, next: the sets under each shingle that several stand with, the size of the smallest of these, that set, one more, and for each set the one after it in a mixed order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column(2).to_pylist()
            counts = np.fromiter((len(x) // 8 for x in prefixes), np.int64, len(prefixes))
            rows = np.zeros(int(counts.sum()), UNDER)
            rows["shingle"] = np.frombuffer(b"".join(prefixes), np.uint64)
            rows["sid"], rows["n"] = np.repeat(batch.column(0).to_numpy(), counts), np.repeat(batch.column(1).to_numpy(), counts)
            rows["rest"] = rows["n"] - (np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts))
            rows = distinct(rows)
            bucket = (rows["shingle"] >> np.uint64(8)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            s = runs_of(bucket)
            yield pa.record_batch([pa.array(bucket[s], pa.int64()), pa.array([planes(x) for x in np.split(rows, s[1:])] if len(s) else [], pa.binary())], ["bucket", "rows"])

    def distinct(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows["sid"], rows["n"], rows["shingle"]))]
        return rows[np.append(True, (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["sid"][1:] != rows["sid"][:-1]))[: len(rows)]]

    def meet(table: pa.Table) -> pa.Table:
        rows = distinct(np.concatenate([from_planes(x.as_py(), UNDER) for x in table.column("rows")]))
        s = runs_of(rows["shingle"])
        sizes = np.diff(np.append(s, len(rows)))
        least, low, high = (np.repeat(x, sizes) for x in (rows["n"][s], rows["sid"][s], np.maximum.reduceat(rows["sid"], s) if len(s) else rows["sid"]))
        by = np.lexsort(((rows["sid"].view(np.uint64) ^ rows["shingle"]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20), rows["shingle"]))
        after = np.append(by[1:], by[:1])
        after[s + sizes - 1] = by[s]  # the last one's is the first
        later = np.empty(len(rows), np.int64)
        later[by] = rows["sid"][after]
        keep = np.repeat(sizes > 1, sizes)
        rows, least, low, high, later = rows[keep], least[keep], low[keep], high[keep], later[keep]
        own = {c: np.ascontiguousarray(rows[c]) for c in ("shingle", "sid", "n", "rest")}
        trim()
        return pa.table({**own, "shingle": own["shingle"].view(np.int64), "least": least, "low": low, "high": high, "next": later})

    dealt = sets.select("sid", "n", "prefix").mapInArrow(frugal(deal), "bucket long, rows binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "shingle long, sid long, n int, rest int, least int, low long, high long, next long")


def similar(pairs: DataFrame, info: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs a, b whose sets have at least four fifths of their union in common. info: sid, row, n and the bitmap's longs of each set."""
    longs = [f"m{i}" for i in range(LONGS)]
    left = info.select(F.col("sid").alias("a"), F.col("row").alias("x"), F.col("n").alias("na"), *(F.col(c).alias(f"a{c}") for c in longs))
    right = info.select(F.col("sid").alias("b"), F.col("row").alias("y"), F.col("n").alias("nb"), *(F.col(c).alias(f"b{c}") for c in longs))
    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in longs), F.lit(0))
    may = pairs.join(left, "a").join(right, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)").where(9 * apart <= F.col("na") + F.col("nb"))
    may = scratch.cut(may.select("a", "b", "x", "y"))
    needed = scratch.cut(may.select(F.col("a").alias("sid"), F.col("x").alias("row")).union(may.select("b", "y")).distinct())
    # a bitmap of a bounded size tells each task which of its documents may be needed; their words move compressed, at a third of their hashes' bytes
    table = docs.sparkSession.sparkContext.broadcast(decontaminate.bitmap(needed.select(F.xxhash64("row").alias("hash")), max(1, needed.count())))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            hashes = batch.column(0).to_numpy().view(np.uint64)
            at = decontaminate.may_be(hashes, table.value)
            at = pa.array(at[np.unique(hashes[at], return_index=True)[1]])
            lines = [b" ".join(t.lower().split()) for t in batch.column(2).take(at).to_pylist()]
            packed = [pa.compress(x, codec="zstd", asbytes=True) for x in lines]
            yield pa.record_batch([batch.column(1).take(at), pa.array([len(x) for x in lines], pa.int64()), pa.array(packed, pa.binary())], ["row", "size", "line"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for b, n, line, m, other in zip(*(batch.column(c).to_pylist() for c in ("b", "n", "line", "m", "other")), strict=True):
                if b != last:
                    last, own = b, shingles(pa.decompress(line, n, codec="zstd", asbytes=True))
                with_ = shingles(pa.decompress(other, m, codec="zstd", asbytes=True))
                common = len(np.intersect1d(own, with_, assume_unique=True))
                keep.append(9 * common >= 4 * (len(own) + len(with_)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    row = row_digest()
    own = docs.select(F.xxhash64(row), row, text_bytes()).mapInArrow(frugal(pack), "row binary, size long, line binary")
    own = scratch.cut(own.join(needed, "row").dropDuplicates(["row"]).select("sid", "size", "line"))
    table.unpersist()
    both = may.select("a", "b").join(own.toDF("a", "m", "other"), "a").join(own.toDF("b", "n", "line"), "b")
    found = scratch.cut(both.select("a", "b", "n", "line", "m", "other").mapInArrow(frugal(compare), "a long, b long"))
    for t in (own, may, needed):
        scratch.drop(t)
    return found


def set_components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """row, did and first of every document: did and row of the first document that it reaches over equal or similar sets and over fingerprints within four bits."""
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(frequent(docs, scratch))
    sets = scratch.cut(shingle_sets(docs, levels))
    levels.unpersist()
    # equal fingerprints, and those within four bits
    fps = scratch.cut(sets.groupBy("fp").agg(F.min("sid").alias("one")))
    same = sets.select("sid", "fp").distinct().join(fps, "fp").select(F.col("sid").alias("a"), F.col("one").alias("b")).where("a <> b")
    near = scratch.cut(links(fps.select("fp"), fps.count()))
    near = near.join(fps.toDF("a", "one"), "a").select("b", F.col("one").alias("x")).join(fps.toDF("b", "one"), "b").select(F.col("x").alias("a"), F.col("one").alias("b"))
    info = scratch.cut(sets.groupBy("sid").agg(F.min("row").alias("row"), *(F.min(c).alias(c) for c in ("n", *(f"m{i}" for i in range(LONGS))))))
    # sets that meet under a shingle
    members = scratch.cut(meeting(sets, parts_for(spark, total_bytes(docs), PART_BYTES)))
    order = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = members.select(*order("sid", "low")).union(members.select(*order("sid", "high"))).union(members.select(*order("sid", "next"))).where("a <> b").distinct()
    first = same.union(near).union(similar(pairs, info, docs, scratch))
    roots = scratch.cut(components(first, scratch))
    # what is left between groups under one shingle
    may = members.where("4 * (n + least) <= 9 * rest").drop("least", "low", "high", "next")
    named = may.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    largest = scratch.cut(named.groupBy("shingle", "root").count().groupBy("shingle").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count("*").alias("m")).where("m > 1").drop("m"))
    left = scratch.cut(named.join(largest, "shingle"))
    some = left.where("root <> main").select("shingle", F.col("sid").alias("s"), F.col("n").alias("k"), F.col("rest").alias("q"), F.col("root").alias("r"))
    cross = some.join(left, "shingle").where("r <> root AND 4 * (k + n) <= 9 * least(q, rest)").select(*order("s", "sid")).distinct()
    second = similar(cross, info, docs, scratch)
    for table in (members, left, info):
        scratch.drop(table)
    for c in ("a", "b"):
        second = second.join(roots.toDF(c, "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    ends = scratch.cut(components(second, scratch))
    of = sets.select("row", "did", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("row", "did", F.coalesce("root", "sid").alias("node"))
    of = scratch.cut(of.join(ends, "node", "left").select("row", "did", F.coalesce("root", "node").alias("root")))
    firsts = scratch.cut(of.groupBy("root").agg(F.min(F.struct("did", "row")).alias("first"), F.count("*").alias("n")))
    return scratch.cut(join_apart(of, firsts, "root").select("row", "did", "first"))


def keep_first_similar(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each group one stays, that with the smallest doc_id.

    Groups are joined by five-word shingle sets of a Jaccard similarity of 0.8 or more, found exactly, and by
    fingerprints within four bits. Words are compared in lower case; texts without words, null ones among them, are one group; whole texts are
    compared whatever their length. A row without an id comes after those with one; among rows with one id, or without, that with the least digest
    of its text stays, and of rows that agree in id and text any one. All columns of docs come back unchanged; an empty table gives an empty result."""
    row, touched, one = fresh(docs, "row", "touched", "one")
    scratch = Scratch(docs.sparkSession)
    found = set_components(docs, scratch)
    goes = (F.col("first.did") != F.col("did")) | (F.col("first.row") != F.col("row"))
    judged = scratch.cut(found.groupBy("row").agg(F.max(goes).alias("goes"), F.count("*").alias("n")).where("goes OR n > 1"))
    # a bitmap of a bounded size tells which rows may go or stand there several times; only these are moved
    table = docs.sparkSession.sparkContext.broadcast(decontaminate.bitmap(judged.select(F.xxhash64("row").alias("hash")), max(1, judged.count())))

    @F.arrow_udf("boolean")
    def may_be_judged(hashes: pa.Array) -> pa.Array:
        out = np.zeros(len(hashes), bool)
        out[decontaminate.may_be(hashes.to_numpy().view(np.uint64), table.value)] = True
        return pa.array(out)

    rows = docs.withColumn(row, row_digest()).withColumn(touched, may_be_judged(F.xxhash64(row)))
    moved = rows.where(F.col(touched)).groupBy(row).agg(F.any_value(F.struct(*quoted(docs.columns))).alias(one))
    moved = moved.join(judged.where("goes").select(F.col("row").alias(row)), row, "left_anti")
    return rows.where(~F.col(touched)).select(*quoted(docs.columns)).unionByName(moved.select(f"{one}.*"))
