"""Near-duplicate vectors by spherical caps: vectors of one label with a cosine of at least a threshold are linked.

A filter is a direction, and a vector goes to each filter whose direction lies within an angle of its own, the cap. Two near vectors
share a filter with a chance that depends on their angle alone. Directions are products of a random code: space is
turned and cut into blocks, each block has its own list of random unit vectors, and a filter takes one of each block. So a vector is decoded
block by block, and only beginnings that can still reach the cap are followed; the lists are short where the filters are many. The height of the caps
comes from the number of vectors (about one unrelated vector a filter), the number of filters from the share of pairs at the threshold that shall meet.

Rows of filters with one vector are left out before vectors move. Filters with many vectors hold a dense group, in which all pairs
can't be tried. There the mean of the filter's vectors is the centre of a ball with half the threshold's angle: two
vectors within it are linked by the triangle inequality, so a ball's links are counted and not tried. What is left is
tried in pairs of chunks of a bounded size, never within a ball, and each pair counts under the least filter that both have. Tasks hand on counts
a vector and spanning forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.codebook import finite
from ledgerloom.llm.common import NO_ID, Scratch, join_apart, known_id
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import roots

COSINE = 0.93
#: Filters that a pair at the threshold shares on average: with CODES codes 1 in 100 such pairs is missed by measure, and of closer ones fewer.
MEET = 8.0
#: Product codes that share the filters.
CODES = 32
#: Shorter vectors get zeros.
LEAST_DIMS = 4
#: Vectors of a filter that are tried at once; a filter with more is dense.
CHUNK = 512
#: Vectors that are decoded at once.
BLOCK = 1024
SEED = 13


def _tail(height: float, dims: int) -> float:
    """The chance that a random direction lies within a cap: its cosine with the centre is at least the height."""
    x = np.linspace(-1, 1, 20001)[1:-1]
    density = np.exp((dims - 3) / 2 * np.log1p(-x * x)) if dims > 2 else 1 / np.sqrt(1 - x * x)
    return float(density[x >= height].sum() / density.sum())


def _both(height: float, dims: int, cosine: float) -> float:
    """The chance that the second of two vectors with this cosine lies within a cap that holds the first."""
    x = np.linspace(height, 1, 400)[:-1]
    density = np.exp((dims - 3) / 2 * np.log1p(-x * x)) if dims > 2 else 1 / np.sqrt(1 - x * x)
    beyond = (height - cosine * x) / np.sqrt((1 - cosine**2) * (1 - x * x))
    second = np.array([_tail(b, dims - 1) if -1 < b < 1 else float(b <= -1) for b in beyond])
    return float((density * second).sum() / density.sum())


def plan(dims: int, count: int, cosine: float = COSINE, meet: float = MEET) -> tuple[float, int]:
    """The height of the caps and the size of the lists for vectors of `dims` components, of which about `count` are alike in label and size."""
    dims = max(dims, LEAST_DIMS)
    blocks = _blocks(dims)
    chance = min(0.02, max(1e-7, 1 / max(1, count))) if blocks > 1 else 0.02
    low, high = 0.0, 1.0
    for _ in range(40):
        height = (low + high) / 2
        low, high = (height, high) if _tail(height, dims) > chance else (low, height)
    wanted = meet / (_both(height, dims, cosine) * max(_tail(height, dims), 1e-9))
    return height, math.ceil((wanted / CODES) ** (1 / blocks))


def _blocks(dims: int) -> int:
    return 2 if dims >= 12 else 1


class Filters:
    """CODES product codes of directions, by the figures of plan().

    Directions of one product have blocks in common, so pairs that meet in one of them tend to meet in others; several turned codes, each with a share of the
    filters, even that out. Where there are few dimensions to cut, a code has one block."""

    def __init__(self, dims: int, height: float, size: int):
        self.dims, self.height, self.size = max(dims, LEAST_DIMS), height, size
        self.blocks = _blocks(self.dims)
        rng = np.random.default_rng(SEED + self.dims)
        places = np.array_split(np.arange(self.dims), self.blocks)
        self.codes = []
        for _ in range(CODES):
            turn = np.linalg.qr(rng.normal(size=(self.dims, self.dims)))[0]
            lists = [rng.normal(size=(size, len(p))) for p in places]
            lists = [x / np.linalg.norm(x, axis=1, keepdims=True) * math.sqrt(len(p) / self.dims) for p, x in zip(places, lists, strict=True)]
            self.codes.append([turn[:, p] @ x.T for p, x in zip(places, lists, strict=True)])

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """owner, filter: for unit vectors (rows) all filters whose caps they are in."""
        long = np.zeros((len(vectors), self.dims))
        long[:, : vectors.shape[1]] = vectors
        found = [self._decode([long @ block for block in code]) for code in self.codes]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] + k * self.size**self.blocks for k, x in enumerate(found)])

    def _decode(self, fits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The choices of one direction a block whose sum reaches the height; fits: for each block the products of the vectors with its list."""
        n = len(fits[0])
        best = [f.max(axis=1) for f in fits]
        owner, reached, chosen = np.arange(n), np.zeros(n), np.zeros(n, np.int64)
        for k, fit in enumerate(fits):
            rest = sum(best[k + 1 :], np.zeros(n))
            order = np.argsort(fit, axis=1)
            rising = np.take_along_axis(fit, order, axis=1)
            need = self.height - reached - rest[owner]
            # a row is searched among all rows at once: rows stand 4 apart, and what lies within the rounding of that is judged again below
            at = np.searchsorted((rising + 4.0 * np.arange(n)[:, None]).ravel(), np.clip(need, -1.5, 1.5) + 4.0 * owner - 1e-9) - owner * self.size
            each = self.size - at
            row = np.repeat(np.arange(len(owner)), each)
            place = np.repeat(at, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            owner = owner[row]
            reached, chosen = reached[row] + rising[owner, place], chosen[row] * self.size + order[owner, place]
            keep = reached + rest[owner] >= self.height
            owner, reached, chosen = owner[keep], reached[keep], chosen[keep]
        return owner, chosen


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists have one size."""
    size = len(column[0]) if len(column) else 0
    offsets = column.offsets.to_numpy()
    v = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64).reshape(len(column), size)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _filtered(distinct: DataFrame, cosine: float, meet: float) -> DataFrame:
    """node and key of every filter that a vector is in; a key stands for a label, a size and a filter."""
    counts = distinct.groupBy("size", "label").count().groupBy("size").agg(F.max("count").alias("n")).where("n > 1").collect()
    plans = {r.size: plan(r.size, r.n, cosine, meet) for r in counts}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Filters] = {}
        for batch in batches:
            for size in set(batch.column(2).to_pylist()) & plans.keys():
                some = batch.filter(pa.compute.equal(batch.column(2), size))
                filters = made.get(size) or made.setdefault(size, Filters(size, *plans[size]))
                for k in range(0, some.num_rows, BLOCK):
                    part = some.slice(k, BLOCK)
                    owner, chosen = filters.decode(_vectors(part.column(3)))
                    owner = pa.array(owner)
                    yield pa.record_batch([*(part.column(c).take(owner) for c in range(3)), pa.array(chosen)], ["node", "label", "size", "filter"])

    rows = distinct.select("node", "label", "size", "vector").mapInArrow(work, f"node long, label {distinct.schema['label'].dataType.simpleString()}, size int, filter long")
    return rows.select("node", F.xxhash64("label", "size", "filter").alias("key"))


def _balls(live: DataFrame, distinct: DataFrame, scratch: Scratch, cosine: float, chunk: int) -> DataFrame:
    """node and ball for vectors near the centre of a dense filter. live: node, key, m (vectors of the key)."""
    dense = scratch.cut(live.where(F.col("m") > chunk))
    # the filters of a dense group agree on one of them, in two steps: the largest that a vector is in, the largest of these for a filter's vectors
    most = scratch.cut(dense.groupBy("node").agg(F.max(F.struct("m", "key")).alias("most")))
    votes = dense.join(most, "node")
    main = scratch.cut(votes.groupBy("key").agg(F.max("most")["key"].alias("main"), F.count("*").alias("n")))
    at = scratch.cut(join_apart(dense.select("node", "key"), main, "key").groupBy("node", "main").agg(F.lit(1).alias("x")))
    centred = dense.join(main.select(F.col("main").alias("key")).distinct(), "key").select("node", "key")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for size in set(batch.column(1).to_pylist()):
                some = batch.filter(pa.compute.equal(batch.column(1), size))
                keys, of = np.unique(some.column(0).to_numpy(), return_inverse=True)
                sums = np.zeros((len(keys), size))
                np.add.at(sums, of, _vectors(some.column(2)))
                yield pa.record_batch([pa.array(np.repeat(keys, size)), pa.array(np.tile(np.arange(size, dtype=np.int32), len(keys))), pa.array(sums.ravel())], ["key", "place", "total"])

    whole = distinct.select("node", "size", "vector")
    sums = centred.join(whole, "node").select("key", "size", "vector").mapInArrow(summed, "key long, place int, total double")
    sums = sums.groupBy("key", "place").agg(F.sum("total").alias("total"))
    centres = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("centre"))  # one row a component
    n = at.groupBy("main").agg(F.count("*").alias("n"))
    centres = scratch.cut(centres.select("key", F.transform("centre", lambda x: x["total"]).alias("centre")).join(n.withColumnRenamed("main", "key"), "key"))
    near = math.cos(math.acos(cosine) / 2) + 1e-9

    @F.arrow_udf("boolean")
    def within(vectors: pa.Array, centres: pa.Array) -> pa.Array:
        sizes = pa.compute.list_value_length(vectors).to_numpy()
        out = np.zeros(len(sizes), bool)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero((sizes == size) & (pa.compute.list_value_length(centres).to_numpy() == size))
            if len(own):
                c = np.stack([centres[i].values.to_numpy(zero_copy_only=False) for i in own.tolist()])
                norm = np.linalg.norm(c, axis=1)
                out[own] = (norm > 0) & (np.einsum("ij,ij->i", _vectors(vectors.take(pa.array(own))), c) >= near * norm)
        return pa.array(out)

    tried = join_apart(at.select("node", F.col("main").alias("key")), centres, "key").join(whole, "node")
    return tried.where(within("vector", "centre")).groupBy("node").agg(F.min("key").alias("ball"))


def _dealt(live: DataFrame, balls: DataFrame, scratch: Scratch, chunk: int, any_dense: bool) -> DataFrame:
    """node, ball, key, task, side: the vectors of each filter by tasks; in a task with sides 0 and 1 the pairs of vectors on either side are tried, else all.

    A filter that isn't dense is one task. The others' vectors are cut into chunks, those of each ball and the loose ones apart; each pair of chunks that
    aren't of one ball is a task, and so is each loose chunk."""
    if not any_dense:
        return live.select("node", F.lit(None).cast("long").alias("ball"), "key", F.lit(0).cast("long").alias("task"), F.lit(-1).alias("side"))
    part = ["key", "loose", "part"]
    named = live.join(balls, "node", "left").withColumn("loose", F.col("ball").isNull()).withColumn("part", F.coalesce("ball", F.lit(0)))
    named = scratch.cut(named)
    cell = F.struct("loose", "part", "number")
    dense = named.where(F.col("m") > chunk)
    parts = scratch.cut(dense.groupBy(part).agg(F.count("*").alias("n")).withColumn("of", F.ceil(F.col("n") / (chunk // 2)).cast("int")))
    cells = parts.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select("key", cell.alias("one"))
    pairs = cells.join(cells.withColumnRenamed("one", "two"), "key")
    pairs = scratch.cut(pairs.where("one <= two AND (one.loose OR two.loose OR one.part <> two.part)"))
    wanted = pairs.select("key", F.col("one").alias("cell"), "one", "two", F.when(F.expr("one = two"), -1).otherwise(0).alias("side"))
    wanted = wanted.union(pairs.where("one <> two").select("key", F.col("two").alias("cell"), "one", "two", F.lit(1).alias("side")))
    numbered = join_apart(dense.select("node", "ball", *part), parts, part).withColumn("number", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    dealt = numbered.select("node", "ball", "key", cell.alias("cell")).join(wanted, ["key", "cell"]).select("node", "ball", "key", F.xxhash64("one", "two").alias("task"), "side")
    return named.where(F.col("m") <= chunk).select("node", "ball", "key", F.lit(0).cast("long").alias("task"), F.lit(-1).alias("side")).union(dealt)


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within each of some groups that stand one after another."""
    n = int(sizes.sum())
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.arange(n) - begin
    second = np.repeat(np.arange(n), before)
    return np.arange(len(second)) - np.repeat(np.cumsum(before) - before, before) + begin[second], second


def _linked(table: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Pairs of rows that are to be linked, and the table in the order that the pairs are given in. table: the rows of some tasks, with vectors of one size."""
    label = np.unique([str(x) for x in table.column("label").to_pylist()], return_inverse=True)[1]
    key, task, side, node = (table.column(c).to_numpy() for c in ("key", "task", "side", "node"))
    order = np.lexsort((node, side, label, task, key))
    table = table.take(pa.array(order))
    key, task, side, node, label = (x[order] for x in (key, task, side, node, label))
    unit = _vectors(table.column("vector").combine_chunks())
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (task[1:] != task[:-1]) | (label[1:] != label[:-1])))
    sizes = np.diff(np.append(new, len(key)))
    found = []
    few = np.repeat(sizes <= 64, sizes)
    where = np.flatnonzero(few)
    a, b = _pairs(sizes[sizes <= 64])
    for k in range(0, len(a), 1 << 15):
        i, j = where[a[k : k + (1 << 15)]], where[b[k : k + (1 << 15)]]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        found.append((i[near], j[near]))
    for k, n in zip(new[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        own = unit[k : k + n]
        for at in range(0, n, 256):
            i, j = np.nonzero(own[at : at + 256] @ own.T >= cosine)
            up = i + at < j
            found.append((i[up] + at + k, j[up] + k))
    i, j = (np.concatenate([x[s] for x in found]) if found else np.zeros(0, np.int64) for s in (0, 1))
    ball = table.column("ball").to_pandas().astype("Int64")
    ball, loose = ball.fillna(0).to_numpy(np.int64), ball.isna().to_numpy()
    good = (side[i] != side[j]) | (side[i] < 0)
    good &= loose[i] | loose[j] | (ball[i] != ball[j])
    i, j = i[good], j[good]
    # a pair counts under the least filter that both vectors are in
    lists = table.column("keys").combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    values = values[offsets[0] : offsets[-1]]
    held = np.diff(offsets)
    row = np.repeat(np.arange(len(held)), held)
    names, number = np.unique(values, return_inverse=True)
    has = np.sort(row * len(names) + number)
    begin = np.cumsum(held) - held
    first = np.ones(len(i), bool)
    for k in range(0, len(i), 1 << 15):
        x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        pair = np.repeat(np.arange(len(x)), held[x])
        at = np.repeat(begin[x], held[x]) + np.arange(len(pair)) - np.repeat(np.cumsum(held[x]) - held[x], held[x])
        lower = values[at] < key[x[pair]]
        pair, at = pair[lower], at[lower]
        code = y[pair] * len(names) + number[at]
        both = has[np.minimum(np.searchsorted(has, code), len(has) - 1)] == code
        first[k + pair[both]] = False
    return i[first], j[first], table


def _tried(dealt: DataFrame, distinct: DataFrame, live: DataFrame, scratch: Scratch, cosine: float) -> DataFrame:
    """node, links, other: counts of vectors linked to a node by weight, and links over which linked nodes reach one another (links: null)."""
    lists = live.groupBy("node").agg(F.collect_list("key").alias("keys"))  # of one vector: as many as its filters
    rows = dealt.join(distinct.join(lists, "node").select("node", "label", "size", "w", "vector", "keys"), "node")
    buckets = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-dealt.count() // (1 << 14)))
    kind = [("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]

    def work(table: pa.Table) -> pa.Table:
        out = []
        for size in pa.compute.unique(table.column("size")).to_pylist():
            i, j, own = _linked(table.filter(pa.compute.equal(table.column("size"), size)), cosine)
            node, w = own.column("node").to_numpy(), own.column("w").to_numpy()
            names, at = np.unique(node, return_inverse=True)
            count = np.bincount(at[i], w[j], len(names)) + np.bincount(at[j], w[i], len(names))
            some = np.flatnonzero(count)
            out.append(pa.table([pa.array(names[some]), pa.array(count[some].astype(np.int64)), pa.nulls(len(some), pa.int64())], schema=pa.schema(kind)))
            root = roots(at[i], at[j], len(names))
            moved = np.flatnonzero(root != np.arange(len(names)))
            out.append(pa.table([pa.array(names[moved]), pa.nulls(len(moved), pa.int64()), pa.array(names[root[moved]])], schema=pa.schema(kind)))
        return pa.concat_tables(out)

    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "task"), F.lit(buckets)))
    return scratch.cut(rows.groupBy("bucket").applyInArrow(work, "node long, links long, other long"))


def near_vectors(rows: DataFrame, cosine: float = COSINE, meet: float = MEET, chunk: int = CHUNK) -> DataFrame:
    """Links between near vectors of one label, and the groups that they make.

    rows: vec_id, embedding, label. Returns vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id reachable over links, the vector's own included)
    and kept (vec_id = component_id) for each row. Vectors are linked only if their labels are equal and not null, their sizes are equal, and their cosine, in double precision, is at
    least `cosine`; none below that is linked, and of the pairs at the bound about one in 100 is missed, of closer ones fewer (tested). Vectors that are null, empty, zero or hold nulls or what isn't finite link with nothing. Equal vectors of one label are
    one node with a weight, and are all linked; so are the ones in a ball (see above). Repeated rows are vectors of their own, linked as copies are; a null vec_id counts as the largest id and stays null, with a null component_id where no row of the
    group has an id; kept is false for it; long vectors are read whole; an empty table gives an empty result; other columns aren't read."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    usable = F.coalesce(F.col("label").isNotNull() & finite() & F.exists("embedding", lambda x: x != 0), F.lit(False))
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("usable", usable)
    # two hashes stand for a label and a vector; rows keep these, so that vectors are moved once
    marks = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", "label").alias("h2")]
    marked = scratch.cut(plain.select("vec_id", "usable", *(F.when(F.col("usable"), m).alias(f"h{i}") for i, m in enumerate(marks, 1))))
    of = plain.where("usable").select("label", F.col("embedding").alias("vector"), F.size("embedding").alias("size"), known_id("vec_id").alias("vec_id"), *marks)
    distinct = of.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.any_value("size").alias("size"))
    distinct = scratch.cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    filtered = scratch.cut(_filtered(distinct, cosine, meet))
    shared = scratch.cut(filtered.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("m", F.col("n")))
    live = scratch.cut(join_apart(filtered, shared, "key"))
    largest = shared.agg(F.max("m")).first()[0] or 0
    dense = largest > chunk
    balls = scratch.cut(_balls(live, distinct, scratch, cosine, chunk) if dense else spark.createDataFrame([], "node long, ball long"))
    tried = _tried(scratch.cut(_dealt(live, balls, scratch, chunk, dense)), distinct, live, scratch, cosine)
    weighted = balls.join(distinct.select("node", "w"), "node")
    whole = scratch.cut(weighted.groupBy("ball").agg(F.min("node").alias("root"), F.sum("w").alias("all"), F.count("*").alias("n")))
    in_ball = scratch.cut(join_apart(weighted, whole, "ball"))
    links = tried.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).union(in_ball.select("node", "root"))
    found = scratch.cut(components(links, scratch))
    counted = tried.where("links is not null").select("node", "links").union(in_ball.select("node", F.col("all") - F.col("w")))
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    named = distinct.select("node", "h1", "h2", "least", "w").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counted, "node", "left")
    named = scratch.cut(named.select("h1", "h2", "least", "w", "root", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    least = scratch.cut(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    named = scratch.cut(join_apart(named, least, "root").select("h1", "h2", "n_links", "component_id", F.col("w").alias("n")))
    linked = join_apart(marked.where("usable").select("vec_id", "h1", "h2"), named, ["h1", "h2"])
    linked = linked.select("vec_id", "n_links", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))
    alone = marked.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
