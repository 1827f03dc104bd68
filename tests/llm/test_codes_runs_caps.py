"""Vector codes, periodic runs and near vectors against brute-force versions, with the awkward cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import caps, codebook, periodic, queries

VECTORS = "vec_id long, embedding array<float>, label int, node string, key long, `a.b` int"


def no_id(x):
    return 2**63 - 1 if x is None else x


# --- 11 ---


def vectors(seed: int = 4, n: int = 150, dims: int = 20) -> list[tuple]:
    rng = random.Random(seed)
    out = [(5 * i % 307, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dims)], rng.choice((0, 1, None, 7)), "x", 1, 2) for i in range(n)]
    out += [(400, [0.0] * dims, 1, "x", 1, 2), (401, out[0][1], 1, "x", 1, 2), (402, [0.25, -0.25], None, "x", 1, 2), (403, [], 0, "x", 1, 2), (None, [1e30] + [0.5] * (dims - 1), 0, "x", 1, 2)]
    out += [(404, None, 0, "x", 1, 2), (1, [float("nan")] + [0.0] * (dims - 1), 0, "x", 1, 2), (2, [None] + [0.0] * (dims - 1), 0, "x", 1, 2), (3, [float("-inf")] * dims, 0, "x", 1, 2), out[7], out[7]]
    rng.shuffle(out)
    return out


def brute_codes(table: list[tuple], parts: int, entries: int, rounds: int) -> list[tuple]:
    kept = [(no_id(i), [max(-codebook.MOST, min(codebook.MOST, math.floor(256 * x))) for x in v], lab) for i, v, lab, *_ in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(q) for _, q, _ in kept) // parts))
    kept.sort(key=lambda x: (x[0], x[1]))
    cut = [[(q + [0] * (parts * width - len(q)))[p * width : (p + 1) * width] for p in range(parts)] for _, q, _ in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[nearest(v, p)[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                if own := [v[p] for v, a in zip(cut, at, strict=True) if a[p] == k]:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[nearest(v, p) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    sums: dict = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        sums[lab] = sums.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, sums[lab], digest) for (i, _, lab), f, e in zip(kept, found, errors, strict=True))


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(16, 64, 2), (4, 10, 3), (1, 256, 1)])
def test_codes(spark, parts, entries, rounds):
    table = vectors()
    got = codebook.compress(spark.createDataFrame(table, VECTORS).repartition(5), parts, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((no_id(r[0]), *r[1:]) for r in got.collect()) == brute_codes(table, parts, entries, rounds)


def test_codes_of_little(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codebook.compress(empty).collect() == []
    assert codebook.compress(spark.createDataFrame([(1, None, 0, "", 0, 0)], VECTORS)).collect() == []
    one = codebook.compress(spark.createDataFrame([(9, [0.5, 0.25], None, "", 0, 0)], VECTORS)).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(9, "00" * 16, 0, 0)]


def test_search_is_exact():
    """Against all distances, with equal sums, equal entries and ties."""
    rng = np.random.default_rng(3)
    for spread in (2, 9, 400):
        entries = rng.integers(-spread, spread, (5, 64, 4))
        entries[:, 10] = entries[:, 40]
        some = rng.integers(-spread, spread, (700, 5, 4))
        at, distance = codebook.Codebook(entries).search(some)
        every = ((some[:, :, None, :] - entries[None]) ** 2).sum(axis=3)
        assert (at == every.argmin(axis=2)).all() and (distance == every.min(axis=2)).all()


# --- 12 ---


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - begin + q >= max(6, 4 * q):
                out.setdefault((begin, i - begin + q), q)
            i += 1
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda x: (x[0], x[2]))


def periodic_words(rng: random.Random, letters: int, pieces: int) -> list[str]:
    out: list[str] = []
    for _ in range(pieces):
        out += [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(12))]
        root = [f"w{rng.randrange(letters)}" for _ in range(rng.randint(1, 15))]
        out += [root[i % len(root)] for i in range(rng.randint(1, 7 * len(root)))]
    return out


def test_runs(monkeypatch):
    rng = random.Random(8)
    for _ in range(250):
        block = [[w.encode() for w in periodic_words(rng, rng.choice((1, 2, 3, 40)), rng.randint(0, 4))] for _ in range(rng.randint(0, 5))]
        monkeypatch.setattr(periodic, "TREE", rng.choice((8, 60, 1 << 16)))
        assert [[tuple(r) for r in x.tolist()] for x in periodic.find_runs(block)] == [brute_runs(w) for w in block]


def test_extensions():
    """Common extensions and both orders of the suffixes against the words themselves."""
    rng = random.Random(1)
    for letters in (1, 2, 5):
        text = np.array([*(rng.randrange(letters) + 2 for _ in range(60)), 0, *(rng.randrange(letters) + 2 for _ in range(30)), 1])
        x, t = periodic.Extensions(text, 2), text.tolist()
        for i in range(len(t)):
            for j in range(len(t)):
                if i != j:
                    n = next(k for k in range(len(t)) if i + k >= len(t) or j + k >= len(t) or t[i + k] != t[j + k])
                    assert x.common(np.array([i]), np.array([j]))[0] == n
        flip = lambda v: [-c if c > 1 else c - 100 for c in v]
        assert sorted(range(len(t)), key=lambda i: t[i:]) == np.argsort(x.rank).tolist()
        inside = range(60)
        assert sorted(inside, key=lambda i: flip(t[i:61])) == sorted(inside, key=lambda i: x.reverse_rank[i])


def run_texts(long: int = 9000) -> list[tuple]:
    rng = random.Random(6)
    texts = [" ".join(periodic_words(rng, 30, 3)) for _ in range(30)] + [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a  b\na\tb a b a b", "é x " * 9, " ".join(f"u{i}" for i in range(300))]
    texts += [" ".join(f"p{i % (long // 5)}" for i in range(long)), "z " * (long // 3)]
    out = [(7 * i + 1, t, "s", 1, 2) for i, t in enumerate(texts)]
    out += [(None, "b c " * 8, "s", 1, 2), out[3], out[3]]
    rng.shuffle(out)
    return out


RUN_SCHEMA = "doc_id long, text string, runs string, words int, `a.b` int"


def split(text):
    return [w for w in (text or "").encode().split()]


def collapsed(words: list[bytes]) -> tuple[list, bytes]:
    found = brute_runs(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return found, b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs(spark):
    got = periodic.periodic_runs(spark.createDataFrame(run_texts(), RUN_SCHEMA).repartition(4)).collect()
    want = sorted((no_id(i), len(split(t)), *collapsed(split(t))) for i, t, *_ in run_texts())
    assert sorted((no_id(r.doc_id), r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in got) == want
    assert periodic.periodic_runs(spark.createDataFrame([], RUN_SCHEMA)).collect() == []


def test_periodic_query(spark, tmp_path):
    """The query plants its periods; against brute force and against its SQL."""
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(run_texts(300) * 4)], RUN_SCHEMA)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    names = sorted(got.columns)
    got = sorted(tuple(r[c] for c in names) for r in got.collect())
    want = []
    for i, t, *_ in ((i, *r[1:]) for i, r in enumerate(run_texts(300) * 4)):
        words, h = split(t), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found, text = collapsed(words)
        top = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        want.append({"doc_id": i, "n_runs": len(found), "start": top[0], "length": top[1], "period": top[2], "exponent_milli": top[1] and 1000 * top[1] // top[2], "runs_sha256": hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(text).hexdigest()})
    assert got == sorted(tuple(x[c] for c in names) for x in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.PERIODIC_RUNS_SQL})").fetchall()) == got


# --- 13 ---


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def near_table(seed: int = 5, dims: int = 24) -> list[tuple]:
    """Pairs at some cosines, a narrow and a wide dense group, copies; each for two labels and for none."""
    rng = np.random.default_rng(seed)
    out = []
    for lab in (0, 1, None):
        base = unit(rng.normal(size=(60, dims)))
        out += [(x, lab) for x in base]
        for c in (0.935, 0.95, 0.99):
            for b in base[:40]:
                u = rng.normal(size=dims)
                out.append((c * b + np.sqrt(1 - c * c) * unit(u - (u @ b) * b), lab))
        for spread, n in ((0.03, 90), (0.075, 50)):
            centre = unit(rng.normal(size=dims))
            out += [(3 * unit(centre + spread * rng.normal(size=dims)), lab) for _ in range(n)]
        out += [(base[3], lab)] * 5
    random.Random(seed).shuffle(out)
    return [(i, [float(np.float32(v)) for v in x], lab, "z", 1, 2) for i, (x, lab) in enumerate(out)]


@pytest.mark.parametrize("chunk", [512, 40])
def test_near_vectors(spark, chunk):
    table = near_table()
    n = len(table)
    x = unit(np.array([r[1] for r in table], np.float64))
    label = np.array([-1 if r[2] is None else r[2] for r in table])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label) & (label >= 0)
    np.fill_diagonal(linked, False)
    odd = [None, [0.0] * 24, [math.nan] + [1.0] * 23, [None] + [1.0] * 23, [math.inf] + [1.0] * 23, []]
    table += [(n + i, v, 0, "z", 1, 2) for i, v in enumerate(odd)]
    short = [[1.0, 2.0], [1.0, 2.0], [1e30, 2e30], [1e-30, 2e-30]]
    table += [(n + 10 + i, v, 0, "z", 1, 2) for i, v in enumerate(short)] + [(None, [1.0, 2.05], 0, "z", 1, 2), (n + 20, [-1.0, -2.0], 0, "z", 1, 2)]
    result = caps.near_vectors(spark.createDataFrame(table, VECTORS).repartition(6), chunk=chunk)
    assert result.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = {r.vec_id: r for r in result.collect()}
    assert len(got) == len(table)
    found = np.array([got[i].n_links for i in range(n)])
    want = linked.sum(axis=1)
    assert (found <= want).all()
    assert found.sum() >= 0.998 * want.sum()
    sure = (x @ x.T >= 0.96) & linked  # closer pairs aren't missed here
    assert (found >= sure.sum(axis=1)).all()
    root = np.arange(n)
    for _ in range(n):
        new = np.array([min(root[i], root[linked[i]].min(initial=n)) for i in range(n)])
        if (new == root).all():
            break
        root = new
    assert sum(got[i].component_id != root[i] for i in range(n)) <= 0.01 * n
    assert all(got[i].kept == (got[i].component_id == i) for i in range(n))
    assert [(got[n + i].n_links, got[n + i].component_id, got[n + i].kept) for i in range(len(odd))] == [(0, n + i, True) for i in range(len(odd))]
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (n + 10, n + 11, n + 12, n + 13, None, n + 20)] == [(4, n + 10, i == 0) for i in range(5)] + [(0, n + 20, True)]


def test_near_vectors_of_little(spark):
    assert caps.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    rows = caps.near_vectors(spark.createDataFrame([(4, [1.0, 0.0], 0, "", 0, 0), (None, [3.0], None, "", 0, 0)], VECTORS)).collect()
    assert sorted((no_id(r.vec_id), r.n_links, r.component_id, r.kept) for r in rows) == [(4, 0, 4, True), (2**63 - 1, 0, None, False)]


@pytest.mark.parametrize(("dims", "count"), [(64, 1000), (64, 100_000), (24, 400), (6, 50)])
def test_filters_meet(dims, count):
    """Pairs at the threshold share a filter in nearly all cases, whatever the number of vectors; a vector has few filters, and unrelated vectors share few."""
    filters = caps.Filters(dims, *caps.plan(dims, count))
    rng = np.random.default_rng(2)
    a = unit(rng.normal(size=(400, dims)))
    u = rng.normal(size=(400, dims))
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * unit(u - (u * a).sum(axis=1, keepdims=True) * a)
    (i, f), (j, g) = filters.decode(a), filters.decode(b)
    of_a, of_b = [set() for _ in a], [set() for _ in a]
    for k, x in zip(i.tolist(), f.tolist(), strict=True):
        of_a[k].add(x)
    for k, x in zip(j.tolist(), g.tolist(), strict=True):
        of_b[k].add(x)
    assert sum(bool(x & y) for x, y in zip(of_a, of_b, strict=True)) >= 0.97 * 400
    assert len(i) <= 60 * 400
    # decoding finds just the directions within the height
    for k in range(3):
        fits = [[a[k] @ block for block in code] for code in filters.codes]
        sums = [x[0] if len(x) == 1 else np.add.outer(x[0], x[1]).ravel() for x in fits]
        assert {n * filters.size**filters.blocks + m for n, s in enumerate(sums) for m in np.flatnonzero(s >= filters.height).tolist()} == of_a[k]


def test_near_vectors_sql(spark, tmp_path):
    """The query's SQL, where pairs lie well over or under the threshold."""
    rng = np.random.default_rng(9)
    base = unit(rng.normal(size=(60, 32)))
    table = [(i, [float(x) for x in np.float32(v)], i % 3, "z", 1, 2) for i, v in enumerate(base)]
    table += [(100 + i, [float(x) for x in np.float32(v + 0.01 * rng.normal(size=32))], i % 3, "z", 1, 2) for i, v in enumerate(base[:20])] + [(200, None, 1, "z", 1, 2)]
    spark.createDataFrame(table, VECTORS).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    names = ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(tuple(r) for r in queries.op13_near_vectors(spark, str(tmp_path)).select(names).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.NEAR_VECTORS_SQL})").fetchall()) and sum(r[1] for r in got) == 40
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(tuple(r) for r in queries.op11_vector_codes(spark, str(tmp_path)).select(names).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.VECTOR_CODES_SQL})").fetchall())


# --- the pipeline's first stage ---


def test_keep_good_whatever_columns_are_called(spark):
    """Names with dots and quotes, texts of several slices, no rows at all."""
    from ledgerloom.llm.repetition import keep_good

    clean = " ".join(f"w{i}" for i in range(60))
    rows = [(i, clean if i % 2 else "too short", i, "x") for i in range(9)] + [(90, " ".join(f"v{i}" for i in range(900_000)), 1, None), (91, None, 2, None), (None, clean, 3, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `c``d` string").coalesce(1)
    got = keep_good(df)
    assert got.schema.names == df.schema.names and sorted((r[0] is None, r[0] or 0, r[2]) for r in got.collect()) == [(False, i, i) for i in (1, 3, 5, 7)] + [(False, 90, 1), (True, 0, 3)]
    assert keep_good(df.limit(0)).collect() == []
