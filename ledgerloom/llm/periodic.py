"""Runs of words that repeat with a period, by longest common extensions in suffix trees.

A run is a stretch of words that agrees with itself one period further on and that no neighbour extends. By the
theorem on runs, each starts a period with a Lyndon root: the longest Lyndon word at some place, under the order of
the words or its reverse. So each place gives two candidates, and each is extended to the right by the longest common
extension of two suffixes, to the left by that of two suffixes of the reversal. Extensions come from suffix trees
(Ukkonen's construction) and a walk around each: the string depth of the lowest common ancestor of two leaves
is the least one on the walk between them, which a sparse table gives in constant time.

Only stretches that may hold a run go into trees: those where places agree with the place q further on for long enough
(q < GRAM), and the unions of windows of GRAM words that come three times. A run with a period of GRAM or more and
an exponent of four holds each of its windows three times, so no run is left out and none is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import runs_of, text_bytes

#: A run counts from an exponent of this and from so many words on.
EXPONENT, LEAST = 4, 6
#: Words of a window that has to come three times for longer periods.
GRAM = 8
#: Words of texts that are looked at together, and of stretches that share a tree; a longer one has its own.
BATCH, TREE = 1 << 18, 1 << 16

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def suffix_tree(text: list[int], base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ukkonen's tree of a text whose last number comes once; numbers are below base.

    Returns for each node but the root its parent, the first number of its edge, its edge's length, the suffix that ends in it (-1: none), and the node."""
    n = len(text)
    start, end, link, suffix = [0], [0], [0], [-1]
    edges: dict[int, int] = {}
    node = edge = length = waiting = 0
    for i, c in enumerate(text):
        waiting += 1
        made = 0
        while waiting:
            if not length:
                edge = i
            key = node * base + text[edge]
            below = edges.get(key)
            if below is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                suffix.append(i - waiting + 1)
                if made:
                    link[made] = node
                    made = 0
            else:
                begin = start[below]
                size = min(end[below], i + 1) - begin
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                if text[begin + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                inner = len(start)
                edges[key] = inner
                start += (begin, i)
                end += (begin + length, n)
                link += (0, 0)
                suffix += (-1, i - waiting + 1)
                edges[inner * base + c] = inner + 1
                start[below] = begin + length
                edges[inner * base + text[begin + length]] = below
                if made:
                    link[made] = inner
                made = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    nodes = np.fromiter(edges.values(), np.int64, len(edges))
    starts, ends = np.array(start, np.int64), np.array(end, np.int64)
    return keys // base, keys % base, (ends - starts)[nodes], np.array(suffix, np.int64)[nodes], nodes


class Extensions:
    """Longest common extensions of suffixes in constant time, and the order of the suffixes."""

    def __init__(self, text: np.ndarray, ends: int):
        """text: numbers of which those below `ends` come once, stand at the ends of stretches and are smaller than others in either order."""
        base = int(text.max()) + 1
        parent, first, length, suffix, node = suffix_tree(text.tolist(), base)
        n = len(node) + 1
        order = np.lexsort((first, parent))
        parent, first, length, suffix, node = (x[order] for x in (parent, first, length, suffix, node))
        at = runs_of(parent)
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low[parent[at]], high[parent[at]] = at, np.append(at[1:], len(parent))
        # the walk: nodes in the order in which they are entered
        children, a, b = node[::-1].tolist(), (n - 1 - high).tolist(), (n - 1 - low).tolist()
        entered, stack = [], [0]
        while stack:
            x = stack.pop()
            entered.append(x)
            if a[x] < b[x]:
                stack.extend(children[a[x] : b[x]])
        place = np.empty(n, np.int64)
        place[entered] = np.arange(n)
        up = np.zeros(n, np.int64)  # all from here on by places of the walk
        up[place[node]] = place[parent]
        sizes, ups = [1] * n, up.tolist()
        for x in range(n - 1, 0, -1):
            sizes[ups[x]] += sizes[x]
        size = np.array(sizes, np.int64)

        def along(values: np.ndarray) -> np.ndarray:
            """For each node the sum of the values from the root to it."""
            steps = np.append(values, 0)
            np.subtract.at(steps, np.arange(n) + size, values)
            return np.cumsum(steps[:n])

        edge, leaf = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        edge[place[node]], leaf[place[node]] = length, suffix
        depth = along(edge)
        self.table = [depth[up].astype(np.int32)]  # before a node is entered the walk stands at its parent
        while 2 << len(self.table) - 1 <= n:
            step, last = 1 << len(self.table) - 1, self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
        leaves = np.flatnonzero(leaf >= 0)
        self.at = np.empty(len(text), np.int64)
        self.at[leaf[leaves]] = leaves
        self.rank = np.empty(len(text), np.int64)
        self.rank[leaf[leaves]] = np.arange(len(leaves))
        # in the reverse order of words a node follows the leaves of its larger siblings, ends come first as before
        before = np.append(0, np.cumsum(leaf >= 0))
        own = (before[np.arange(n) + size] - before[:n])[place[node]]
        of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(parent))))
        word, total = first >= ends, np.append(0, np.cumsum(own))
        last = np.append(at[1:], len(parent))[of]
        of_ends = np.append(0, np.cumsum(np.where(word, 0, own)))
        ahead = np.where(word, of_ends[last] - of_ends[at][of] + total[last] - total[1:], total[:-1] - total[at][of])
        steps = np.zeros(n, np.int64)
        steps[place[node]] = ahead
        self.reverse_rank = np.empty(len(text), np.int64)
        self.reverse_rank[leaf[leaves]] = along(steps)[leaves]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes from i and from j, other places, have in common."""
        a, b = np.minimum(self.at[i], self.at[j]) + 1, np.maximum(self.at[i], self.at[j]) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.table[k][a[own]], self.table[k][b[own] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank, behind which the longest Lyndon word at the place ends; n: none."""
    ranks, n = rank.tolist(), len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, ranks[i]
        while j < n and ranks[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_in(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """start, length and period of the runs in stretches of word numbers that stand one after another; begins: where each starts.

    Runs are ordered by start and period; none crosses from one stretch to the next."""
    count = len(begins)
    words = np.unique(words, return_inverse=True)[1] + count
    text = np.insert(words, np.append(begins[1:], len(words)), np.arange(count))  # an end after each stretch
    n = len(text)
    forward = Extensions(text, count)
    at = np.concatenate([np.arange(n)] * 2)
    period = np.concatenate([next_smaller(forward.rank), next_smaller(forward.reverse_rank)]) - at
    inside = (text[at] >= count) & (at + period < n)
    at, period = at[inside], period[inside]
    right = forward.common(at, at + period)
    del forward
    if not len(at):
        return np.zeros((0, 3), np.int64)
    # a number of its own is put before the first place, so that each place has one before it
    backward = Extensions(np.append(text[::-1] + 1, 0), count + 1)
    left = backward.common(n - at, n - at - period)
    length = left + period + right
    good = length >= np.maximum(LEAST, EXPONENT * period)
    found = np.unique(np.stack([(at - left)[good], period[good], length[good]], axis=1), axis=0)
    start = found[:, 0]
    start = start - np.searchsorted(np.append(begins[1:], len(words)) + np.arange(count), start)  # without the ends before it
    return np.stack([start, found[:, 2], found[:, 1]], axis=1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def stretches(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches that may hold runs; words: numbers, text after text; ends: for each word where its text ends."""
    n = len(words)
    turns = np.zeros(n + 1, np.int64)  # stretches that begin less stretches that end

    def mark(a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(turns, a, 1)
        np.subtract.at(turns, b, 1)

    for q in range(1, min(GRAM, n)):
        same = np.flatnonzero((words[:-q] == words[q:]) & (ends[:-q] == ends[q:]))
        if not len(same):
            continue
        breaks = np.flatnonzero(np.append(True, (same[1:] != same[:-1] + 1) | (ends[same[1:]] != ends[same[:-1]])))
        first, last = same[breaks], same[np.append(breaks[1:], len(same)) - 1]
        long = last - first + 1 + q >= max(LEAST, EXPONENT * q)
        mark(first[long], last[long] + 1 + q)
    hashes, size = _mixed(words.astype(np.uint64), ends.astype(np.uint64)), 1
    while size < GRAM and len(hashes) > size:
        hashes = _mixed(hashes[:-size], hashes[size:])
        size *= 2
    if size == GRAM:
        whole = np.flatnonzero(np.arange(len(hashes)) + GRAM <= ends[: len(hashes)])
        order = whole[np.argsort(hashes[whole])]
        s = runs_of(hashes[order])
        often = order[np.repeat(np.diff(np.append(s, len(order))) >= 3, np.diff(np.append(s, len(order))))]
        mark(often, often + GRAM)
    alive = np.cumsum(turns)[:n] > 0
    edges = np.flatnonzero(np.append(alive, False) != np.append(False, alive) if n else np.zeros(0, bool))
    edges = np.union1d(edges, ends[:-1][(ends[:-1] != ends[1:]) & alive[:-1] & alive[1:]]) if n else edges  # texts that touch
    starts = edges[:-1][alive[edges[:-1]]] if len(edges) else edges
    stops = edges[np.searchsorted(edges, starts) + 1] if len(starts) else starts
    long = stops - starts >= LEAST
    return starts[long], stops[long]


def runs_of_words(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start, length and period of all runs; words: numbers, text after text; ends: for each word where its text ends. By start and period."""
    starts, stops = stretches(words, ends)
    out, sizes = [], stops - starts
    group = np.zeros(len(starts), np.int64)
    held = number = 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > TREE:
            number, held = number + 1, 0
        group[k] = number
        held += size
    for own in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(group)) + 1) if len(starts) else []:
        begins = np.cumsum(sizes[own]) - sizes[own]
        found = runs_in(np.concatenate([words[starts[k] : stops[k]] for k in own.tolist()]), begins)
        if len(found):
            of = np.searchsorted(begins, found[:, 0], side="right") - 1
            found[:, 0] += starts[own][of] - begins[of]
            out.append(found)
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    """The words of some texts after another; a block has about BATCH words, or one text with more."""
    block, size = [], 0
    for text in texts:
        words = text.split()
        if block and size + len(words) > BATCH:
            yield block
            block, size = [], 0
        block.append(words)
        size += len(words)
    if block:
        yield block


def find_runs(block: list[list[bytes]]) -> list[np.ndarray]:
    """start, length and period of the runs of each text of words, by start and period."""
    sizes = np.array([len(x) for x in block], np.int64)
    numbers = _Numbers()
    words = np.fromiter((numbers[w] for x in block for w in x), np.int64, int(sizes.sum()))
    stops = np.cumsum(sizes)
    found = runs_of_words(words, np.repeat(stops, sizes))
    of = np.searchsorted(stops, found[:, 0], side="right")
    found[:, 0] -= (stops - sizes)[of]
    cuts = np.searchsorted(of, np.arange(len(block) + 1))
    return [found[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run has after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    turns = np.zeros(len(words) + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(turns, runs[:, 0] + runs[:, 1], 1)
    return b" ".join([w for w, gone in zip(words, np.cumsum(turns).tolist(), strict=False) if not gone])


def periodic_runs(docs: DataFrame, digest: bool = False) -> DataFrame:
    """The periodic runs of each text, and the text with each run cut down to its first period.

    docs: doc_id, text. Returns doc_id, n_words, runs (start, length and period in words, numbered from 0; by start, then period): each stretch of words with a smallest period q and at least
    max(LEAST, EXPONENT * q) words that no neighbour extends; collapsed: the words joined by one space, as UTF-8, without those that lie in
    any run after its first q words (digest: the SHA-256 of that instead of it). Null and empty texts, and texts without words, have no words and no run, and collapse to the
    empty text; whole texts are read whatever their length, a long one in a tree by itself; runs that start together are ordered by their period; repeated rows and rows without an id are
    rows like others; an empty table gives an empty result; other columns aren't read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            at = 0
            for block in _blocks(x.as_py() for x in batch.column(1)):
                found = find_runs(block)
                every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in found])), pa.int32())
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, i])) for i in range(3)], ["start", "length", "period"])
                kept = (collapse(w, r) for w, r in zip(block, found, strict=True))
                kept = pa.array([hashlib.sha256(x).digest() if digest else x for x in kept], pa.binary())
                sizes = pa.array([len(x) for x in block], pa.int64())
                yield pa.record_batch([batch.column(0).slice(at, len(block)), sizes, pa.ListArray.from_arrays(offsets, structs).cast(kind), kept], ["doc_id", "n_words", "runs", "collapsed"])
                at += len(block)

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(work, SCHEMA)
