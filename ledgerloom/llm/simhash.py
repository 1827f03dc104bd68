"""Near-duplicate documents by SimHash: fingerprints within four bits of one another are linked.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of both, so each
fingerprint stands for all variants within r = 2 bits of it, 2,081 of 64 bits, and those that share a
variant are linked. Shuffling every variant as a row would move over 30 KB a fingerprint. Instead the
shuffle key is a code of the variant: bit j of the code is the parity of the bits of group j, and as one
flip changes one bit of the code, a fingerprint goes to 1 + g + g(g-1)/2 codes only; the task of a code
makes the variants that belong there (each variant of each fingerprint is made in exactly one place),
sorts them, and links those that are equal. Copies spread over many codes, since flips at different
places lead to different ones. A task hands on a spanning forest, never pairs within a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, join_apart, known_id, runs_of, text_bytes
from ledgerloom.llm.components import components

BITS, SHINGLE, SEED = 64, 4, 42
#: Shingles whose hashes are held at once.
BLOCK = 1 << 18
#: Variants that one task sorts at once.
SORTED = 1 << 21


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: bit i is 1 if it is 1 in more than half of the shingles' hashes; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=False)
        hashes = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in pairs]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(work, "doc_id long, fp long")


def _groups(g: int) -> list[int]:
    """Bit masks of g groups that take turns over the 64 places."""
    return [sum(1 << p for p in range(j, BITS, g)) for j in range(g)]


def flips(g: int, radius: int) -> dict[int, np.ndarray]:
    """Masks of up to radius flipped bits, by what they change in the code."""
    by: dict[int, list[int]] = {}
    for r in range(radius + 1):
        for places in combinations(range(BITS), r):
            code = 0
            for p in places:
                code ^= 1 << (p % g)
            by.setdefault(code, []).append(sum(1 << p for p in places))
    return {code: np.array(masks, np.uint64) for code, masks in by.items()}


def code_groups(n: int, radius: int) -> int:
    """Groups of the code, so that a task has some SORTED variants: 2^g codes share all variants of n fingerprints."""
    variants = n * sum(len(x) for x in flips(1, radius).values())
    return int(min(20, max(6, np.ceil(np.log2(max(1, variants) / SORTED)))))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def meet(fps: np.ndarray, changes: np.ndarray, masks: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints that share a variant of one code; changes: what takes each to that code."""
    made = sum(len(masks[c]) * int((changes == c).sum()) for c in np.unique(changes).tolist())
    rounds = -(-made // (2 * SORTED))
    a, b = [], []
    for turn in range(rounds):
        variants, owners = [], []
        for c in np.unique(changes).tolist():
            own = np.flatnonzero(changes == c)
            for at in range(0, len(own), 1 << 16):
                some = own[at : at + (1 << 16)]
                v = (fps[some][:, None] ^ masks[c][None, :]).ravel()
                o = np.repeat(some, len(masks[c]))
                if rounds > 1:
                    keep = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(rounds) == turn
                    v, o = v[keep], o[keep]
                variants.append(v)
                owners.append(o)
        v, o = np.concatenate(variants), np.concatenate(owners).astype(np.int32)
        order = np.argsort(v)
        v, o = v[order], o[order]
        starts = runs_of(v)
        first = np.repeat(o[starts], np.diff(np.append(starts, len(v))))
        linked = np.unique(np.stack([first, o])[:, first != o], axis=1)
        a.append(linked[0])
        b.append(linked[1])
    if not a:
        return fps[:0], fps[:0]
    root = roots(np.concatenate(a), np.concatenate(b), len(fps))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def links(distinct: DataFrame, n: int, radius: int = 2) -> DataFrame:
    """a, b: links over which fingerprints within 2 * radius bits reach one another. distinct: fp; n: about its rows."""
    g = code_groups(n, radius)
    masks, groups = flips(g, radius), _groups(g)
    code = F.lit(0)
    for j, mask in enumerate(groups):
        signed = mask - (1 << 64) if mask >> 63 else mask
        code = code + F.shiftleft(F.bit_count(F.col("fp").bitwiseAND(F.lit(signed))).bitwiseAND(F.lit(1)), j)
    dealt = distinct.select("fp", code.alias("own")).select("fp", F.explode(F.array([F.lit(c) for c in sorted(masks)])).alias("change"), "own")
    dealt = dealt.select("fp", "change", F.col("own").bitwiseXOR(F.col("change")).alias("code"))

    def work(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        a, b = meet(fps, group.column("change").to_numpy(), masks)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("code").applyInArrow(work, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 2, shingle: int = SHINGLE) -> DataFrame:
    """Groups of near-duplicate documents.

    docs: doc_id, text. Returns doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable over links of at most 2 * radius bits, the document's own included) and n_links (other
    distinct fingerprints of the component).
    Null and empty texts, and texts without words, have fingerprint zero and are linked like others; whole texts
    count whatever their length; equal fingerprints are one node, so ties cost nothing; repeated rows stay as many rows; a null doc_id counts as the largest id and stays null in doc_id;
    an empty table gives an empty result; other columns aren't read."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    fps = scratch.cut(fingerprints(docs, shingle))
    distinct = scratch.cut(fps.groupBy("fp").agg(F.min(known_id()).alias("least"), F.count("*").alias("n")))
    roots_ = components(links(distinct.select("fp"), distinct.count(), radius), scratch)
    named = distinct.join(roots_.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"), (F.count("*") - 1).alias("n_links"))
    of_fp = scratch.cut(named.select("fp", "root", "n").join(whole, "root").drop("root"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_apart(fps, of_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", "n_links")
