"""Removal of repeated chunks: content-defined chunking by a gear rolling hash, chunks compared by digest.

The gear hash of a place depends on the 32 bytes before it. A chunk ends where the hash is the least within
RADIUS bytes on both sides, so chunk ends depend on the text around them alone: after an insertion they fall
into step again, and a passage that two documents share gives both the same chunks inside. Texts are dealt
to parts by doc_id; a part tells the buckets of digests the first place of each of its digests, once for
each digest however many places it has, and buckets answer with the first place of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import known_id, parts_for, runs_of, text_bytes, total_bytes

RADIUS, LONGEST = 32, 4096
PART_BYTES = 8 << 20
BLOCK = 1 << 20
REACH = 32
PLACE = np.dtype([("digest", "S16"), ("did", "<i8"), ("at", "<i8")])


def _gear() -> np.ndarray:
    """A random integer for each byte, by the mixing step of splitmix64."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).astype(np.uint32)


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: gear values of the last 32 bytes, each shifted by its age. Bytes before the first count as none."""
    h = GEAR[data]
    age = 1
    while age < REACH:
        h[age:] = h[age:] + (h[:-age] << np.uint32(age))
        age *= 2
    return h


def _ends(data: np.ndarray, radius: int) -> np.ndarray:
    h = gear_hashes(data)
    span = 2 * radius + 1
    if len(h) < span:
        return np.zeros(0, np.int64)
    least, have = h, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = np.flatnonzero(h[radius : len(h) - radius] == least) + radius
    return at[(np.diff(at, prepend=-span) > radius)] + 1 if len(at) else at


def chunk_ends(text: bytes, radius: int = RADIUS) -> list[int]:
    """Where the chunks of a text end; the last end is the text's."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return []
    margin = REACH + 2 * radius
    found = []
    for at in range(0, n, BLOCK):
        low, high = max(0, at - margin), min(n, at + BLOCK + margin)
        e = _ends(data[low:high], radius) + low
        found.append(e[(e > at) & (e <= at + BLOCK)])
    ends = np.concatenate(found)
    # to the next character's first byte
    for _ in range(3):
        inside = ends < n
        ends = ends + (inside & (data[np.minimum(ends, n - 1)] & 0xC0 == 0x80))
    ends = np.unique(np.append(ends, n))
    if np.diff(ends, prepend=0).max() > LONGEST:
        out: list[int] = []
        for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            while b - a > LONGEST:
                a += LONGEST
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                out.append(a)
            if not out or out[-1] < b:
                out.append(b)
        return out
    return ends.tolist()


def chunks(text: bytes, radius: int = RADIUS) -> tuple[list[int], list[bytes]]:
    """Begins of the chunks and their digests."""
    ends = chunk_ends(text, radius)
    begins = [0, *ends][:-1]
    digest = xxhash.xxh3_128_digest
    return begins, [digest(text[a:b]) for a, b in zip(begins, ends, strict=True)]


def ask(table: pa.Table, buckets: int, radius: int) -> pa.Table:
    """The first place of each digest in a part, by bucket; those with several places come apart."""
    digests, dids, ats = [], [], []
    for did, text in zip(table.column("did").to_pylist(), table.column("text").to_pylist(), strict=True):
        begins, own = chunks(text, radius)
        digests += own
        ats += begins
        dids.append(np.full(len(own), did))
    places = np.zeros(len(ats), PLACE)
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
    places.view(np.uint8).reshape(-1, PLACE.itemsize)[:, :16] = raw
    places["did"] = np.concatenate(dids) if dids else 0
    places["at"] = ats
    high = raw[:, :8].copy().view(">u8").ravel()
    order = np.lexsort((places["at"], places["did"], raw[:, 8:].copy().view(">u8").ravel(), high))
    places, raw = places[order], raw[order]
    s = np.flatnonzero(np.append(True, (raw[1:] != raw[:-1]).any(axis=1))) if len(raw) else np.zeros(0, np.int64)
    first, several = places[s], np.diff(np.append(s, len(places))) > 1
    bucket = (first.view(np.uint8).reshape(-1, PLACE.itemsize)[:, :8].copy().view(">u8").ravel() % np.uint64(buckets)).astype(np.int64)
    out = []
    for flag in (False, True):
        own, b = first[several == flag], bucket[several == flag]
        by = np.argsort(b, kind="stable")
        own, b = own[by], b[by]
        s = runs_of(b)
        out += [(int(v), flag, x.tobytes()) for v, x in zip(b[s], np.split(own, s[1:]) if len(s) else [], strict=True)]
    part = table.column("part")[0].as_py() if table.num_rows else 0
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "part": pa.array([part] * len(out), pa.int64()), "several": pa.array([x[1] for x in out], pa.bool_()), "places": pa.array([x[2] for x in out], pa.binary())})


def _load(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    places = np.frombuffer(b"".join(blobs), PLACE)
    return places, places.view(np.uint8).reshape(-1, PLACE.itemsize)[:, :16]


def answer(table: pa.Table) -> pa.Table:
    """For each part the first place of all of those of its digests that have several places."""
    blobs = table.column("places").to_pylist()
    places, raw = _load(blobs)
    sizes = [len(x) // PLACE.itemsize for x in blobs]
    part, several = np.repeat(table.column("part").to_pylist(), sizes), np.repeat(table.column("several").to_pylist(), sizes)
    order = np.lexsort((places["at"], places["did"], raw[:, 8:].copy().view(">u8").ravel(), raw[:, :8].copy().view(">u8").ravel()))
    places, raw, part, several = places[order], raw[order], part[order], several[order]
    s = np.flatnonzero(np.append(True, (raw[1:] != raw[:-1]).any(axis=1)))
    sizes = np.diff(np.append(s, len(places)))
    keep = np.repeat((sizes > 1) | np.logical_or.reduceat(several, s), sizes)
    first = np.repeat(places[s], sizes)[keep]
    part = part[keep]
    by = np.argsort(part, kind="stable")
    first, part = first[by], part[by]
    cut = runs_of(part)
    return pa.table({"part": pa.array(part[cut], pa.int64()), "places": pa.array([x.tobytes() for x in np.split(first, cut[1:])] if len(cut) else [], pa.binary())})


def remove_repeated_chunks(docs: DataFrame, radius: int = RADIUS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Texts without the chunks that occur earlier, in order of doc_id and then of place.

    docs: doc_id, text. The first place of a chunk stays, wherever it is; all others go, however short. Returns a row for each: doc_id, n_bytes,
    n_chunks, spans (array of begin, end in bytes of the removed chunks, neighbours joined) and text (what
    is left; chunks end between characters). Null and empty texts have no chunks and give an empty
    text; a text shorter than a chunk is one chunk; a very long text is cut block by block, and one row of it stands in one task; a null doc_id comes after all others; rows that repeat an id count as one
    document where their places agree; an empty table gives an empty result; other columns aren't read."""
    spark = docs.sparkSession
    parts = parts_for(spark, total_bytes(docs), part_bytes)
    dealt = docs.select(F.col("doc_id").cast("long"), known_id().alias("did"), text_bytes().alias("text"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("did"), F.lit(parts))).repartition(parts, "part")  # so many tasks, of about a part each
    asked = dealt.groupBy("part").applyInArrow(lambda t: ask(t, parts, radius), "bucket long, part long, several boolean, places binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "part long, places binary")

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        places, raw = _load(answers.column("places").to_pylist() if answers.num_rows else [])
        known = dict(zip([x.tobytes() for x in raw], zip(places["did"].tolist(), places["at"].tolist(), strict=True), strict=True))
        out = []
        for doc_id, did, text in zip(*(table.column(c).to_pylist() for c in ("doc_id", "did", "text")), strict=True) if table.num_rows else []:
            begins, digests = chunks(text, radius)
            spans: list[dict[str, int]] = []
            for a, b, d in zip(begins, [*begins[1:], len(text)], digests, strict=False):
                if known.get(d, (did, a)) == (did, a):
                    continue
                if spans and spans[-1]["end"] == a:
                    spans[-1]["end"] = b
                else:
                    spans.append({"begin": a, "end": b})
            edges = [0, *(x for s in spans for x in (s["begin"], s["end"])), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((doc_id, len(text), len(begins), spans, kept.decode("utf-8", "replace")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string()]
        names = ["doc_id", "n_bytes", "n_chunks", "spans", "text"]
        return pa.table([pa.array([x[i] for x in out], kinds[i]) for i in range(5)], names)

    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(finish, "doc_id long, n_bytes long, n_chunks long, spans array<struct<begin: long, end: long>>, text string")
