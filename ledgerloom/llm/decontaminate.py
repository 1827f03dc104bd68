"""Finding benchmark questions in documents, with other numbers, names or units as well, by templates.

A text becomes a template: numbers, names and units turn into typed placeholders, other words into lower
case without marks around them. Windows of WINDOW template words are hashed, and windows of documents join
those of benchmark items on the hash. A window with placeholders counts only if its slots are filled consistently:
within an occurrence of an item, a value of the item stands for one value in the document.

Windows of few literal words would meet everywhere as templates. They count where a document has them word for word,
where they continue a window that was found, or where the document has the whole item with its slots filled consistently.

The windows of the benchmark are made once, as a table. A bitmap of their hashes, of a bounded size, goes to all tasks, where each
document is read once and passed on only if some window of it may be among them; its windows then join the table on
the hash, and each pair of a document and an item that met is compared word by word. Windows that many documents and items share are left
out of this join as far as they, together, cover too little of an item to count: whoever holds enough of it also holds another of its windows. A phrase
that opens many questions thus makes no pairs. A document's text moves once for some TOGETHER items. Neither the benchmark nor what a document
meets has to fit into a task; tables below a checked size are broadcast, others shuffled.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, by_bytes, fresh, frugal, quoted, row_digest, text_bytes

WINDOW, LEAST_LITERAL = 8, 4
#: The share of an item's words that a document must hold.
LEAST_COVERED = 0.5
#: Words whose forms are held.
HELD = 1 << 20
#: Words that are looked at together; a longer text is looked at alone.
BATCH = 1 << 17
#: Bits of the bitmap a window of the benchmark, and all of them at most; how many of them a window sets.
BITS_EACH, MOST_BITS, PROBES = 64, 1 << 29, 4
#: The bitmap is summed in pieces.
PIECES = 16
#: Items, about, that a document is compared with at once.
TOGETHER = 32
#: Tables of at most so many rows (of some 30 bytes) are broadcast, and benchmark texts of at most so many bytes.
FEW_ROWS, FEW_BYTES = 1 << 20, 16 << 20

#: Unit words, in lower case.
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons tonne tonnes"
    " ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years"
    " mph kph dollar dollars cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit watt watts volt volts joule joules newton newtons hz khz mhz kb mb gb tb".split()
)
NUMBER = re.compile(rb"^[+\-$\xe2\x82\xac\xc2\xa3]*\d[\d.,:/]*(%|st|nd|rd|th)?$")
ORDER = re.compile(rb"^[+\-]?\d[\d.,]*([a-zA-Z]+)$")
MARKS = b".,;:!?\"'()[]{}<>*_#`~|"
STOP = (b".", b"!", b"?", b".\"", b"!\"", b"?\"", b".'", b".)", b":")

#: What a word is: a literal, or the type of its slot.
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
#: Bits beside the type: a capital that makes a name unless a sentence starts there; the end of a sentence; nothing but marks.
CAPITAL, ENDS, EMPTY = 4, 8, 16
SLOT = np.array([0, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


class Words:
    """For each word as it stands a number, and for each number the hash of the word's literal form and its type and bits."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.literal, self.bits = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64)

    def numbers(self, words: list[bytes]) -> list[int]:
        known = self.number
        try:
            return [known[w] for w in words]
        except KeyError:
            return [known[w] if w in known else self._add(w) for w in words]

    def forget(self) -> None:
        """Call between batches: numbers are given anew once HELD words are held."""
        if len(self.number) > HELD:
            self.number = {}

    def _add(self, word: bytes) -> int:
        n = len(self.number)
        if n == len(self.literal):
            self.literal, self.bits = (np.append(x, np.zeros_like(x)) for x in (self.literal, self.bits))
        core = word.strip(MARKS)
        bits = ENDS if word.endswith(STOP) else 0
        low = core.lower()
        if not core:
            bits |= EMPTY
        elif NUMBER.match(core) or ((m := ORDER.match(core)) and m[1].decode().lower() in UNITS):
            bits |= NUM
        elif low.decode("utf-8", "replace") in UNITS:
            bits |= UNIT
        else:
            text = core.decode("utf-8", "replace")
            low = text.lower().encode()
            if len(text) > 1 and text[0].isupper() and not text[1:].isupper():
                bits |= CAPITAL
        self.number[word] = n
        self.literal[n], self.bits[n] = xxhash.xxh3_64_intdigest(low), bits
        return n


class Template(NamedTuple):
    words: np.ndarray  # hashes of the template words
    literal: np.ndarray  # hashes of their literal forms
    kind: np.ndarray
    of: np.ndarray  # the text that each belongs to


def templates(texts: list[bytes], known: Words) -> Template:
    """The template words of all texts, one text after another.

    A unit is one only after a number. A name is a word with a capital that no sentence or line starts with."""
    numbers: list[int] = []
    first: list[int] = []
    upto = [0]
    for text in texts:
        for line in text.split(b"\n"):
            if words := line.split():
                first.append(len(numbers))
                numbers += known.numbers(words)
        upto.append(len(numbers))
    at = np.array(numbers, np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(upto))
    literal, bits = known.literal[at], known.bits[at]
    starts = np.zeros(len(at), bool)
    starts[1:] = bits[:-1] & ENDS > 0
    starts[first] = True
    full = np.flatnonzero(bits & EMPTY == 0)
    # a sentence that starts with mere marks starts with the word after them
    seen = np.cumsum(starts)[full]
    starts = np.diff(seen, prepend=0) > 0
    literal, bits, of = literal[full], bits[full], of[full]
    kind = bits & 3
    after = np.zeros(len(kind), bool)
    after[1:] = (kind[:-1] == NUM) & (of[1:] == of[:-1])
    kind = np.where((kind == UNIT) & ~after, LITERAL, kind)
    kind = np.where((bits & CAPITAL > 0) & ~starts, NAME, kind)
    return Template(np.where(kind == LITERAL, literal, SLOT[kind]), literal, kind, of)


def window_hashes(words: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    """Hashes of all windows of so many words, by size."""
    out, h = {}, np.full(len(words), 0x1B873593, np.uint64)
    for j in range(max(sizes, default=0)):
        h = (h[: max(0, len(words) - j)] ^ words[j:]) * np.uint64(0x9DDFEA08EB382D69)
        h ^= h >> np.uint64(29)
        if j + 1 in sizes:
            out[j + 1] = h * np.uint64(2 * j + 3)
    return out


def enough(kind: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows of a size have enough literal words to tell by their template."""
    upto = np.append(0, np.cumsum(kind == LITERAL))
    return upto[size:] - upto[:-size] >= min(LEAST_LITERAL, size) if size < len(upto) else np.zeros(0, bool)


#: What a window is looked up by, and what is added to its hash for that: the template of one that tells, the literal form of one that
#: doesn't, or the template of one that stands for its whole item.
TELLS, VERBATIM, WHOLE = 0, 1, 2
SALT = np.array([0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D], np.uint64)


class Item:
    """A benchmark item. One shorter than a window is a window as it is."""

    def __init__(self, text: bytes, size: int, known: Words):
        self.words, self.literal, self.kind, _ = templates([text], known)
        self.size = min(size, len(self.words))
        self.tells = enough(self.kind, self.size) if self.size else np.zeros(0, bool)

    def entries(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """How its windows are looked up: what by, hashes, places."""
        if not self.size:
            return []
        h = window_hashes(self.words, {self.size})[self.size]
        own = window_hashes(self.literal, {self.size})[self.size]
        low = np.flatnonzero(~self.tells)
        out = [(TELLS, h, np.flatnonzero(self.tells)), (VERBATIM, own, low)]
        if not self.tells.any() and (self.kind == LITERAL).sum() >= LEAST_LITERAL:
            upto = np.append(0, np.cumsum(self.kind == LITERAL))
            out.append((WHOLE, h, np.array([np.argmax(upto[self.size :] - upto[: -self.size])])))
        return [(k, x[at] ^ SALT[k], at) for k, x, at in out if len(at)]

    def keys(self, often: dict[int, int], least: float) -> list[int]:
        """Hashes of which each text that covers enough has one: all but the most frequent as far as these, with the windows that may
        continue others, cover too little. often: how many pairs each hash makes; one that isn't there is in no text."""
        covered = np.zeros(len(self.words), bool)
        for p in np.flatnonzero(~self.tells).tolist():
            covered[p : p + self.size] = True
        held, at = int(covered.sum()), defaultdict(list)
        for _, hashes, places in self.entries():
            for h, p in zip(hashes.view(np.int64).tolist(), places.tolist(), strict=True):
                at[h].append(p)
        out = []
        for h in sorted(at.keys() & often.keys(), key=lambda h: (-often[h], h)):
            more = {q for p in at[h] for q in range(p, p + self.size) if not covered[q]}
            if (held + len(more)) / len(covered) < least:
                covered[list(more)] = True
                held += len(more)
            else:
                out.append(h)
        return out

    def match(self, doc: Document, least: float) -> tuple[int, float, int, bool] | None:
        """Windows that the document has, the share of the item's words covered, slots in them, and whether a slot is filled otherwise; None if that isn't enough."""
        found: dict[tuple[int, int], None] = {}
        for k, hashes, places in self.entries():
            for d, h in doc.having(self.size, k, hashes):
                for p in places[hashes == h].tolist():
                    if k != WHOLE:
                        found[d, p] = None
                    elif self._whole(d - p, doc.words, doc.literal):
                        found |= {(d - p + q, q): None for q in range(len(self.tells))}
        if not found:
            return None
        if not self.tells.all():
            self._continued(found, doc.words)
        return self._best(list(found), doc.literal, least)

    def _whole(self, begin: int, words: np.ndarray, literal: np.ndarray) -> bool:
        """Whether the text has the item's whole template at `begin`, each value of the item standing for one value."""
        own, there, kinds = self.words, self.literal.tolist(), self.kind.tolist()
        if begin < 0 or not np.array_equal(words[begin : begin + len(own)], own):
            return False
        stands: dict[tuple[int, int], int] = {}
        return all(k == LITERAL or stands.setdefault((k, v), w) == w for k, v, w in zip(kinds, there, literal[begin : begin + len(own)].tolist(), strict=True))

    def _continued(self, found: dict[tuple[int, int], None], words: np.ndarray) -> None:
        """Adds the windows of few literal words that continue one that was found: the template agrees all the way from there."""
        own, tells, size = self.words, self.tells, self.size
        by: dict[int, list[int]] = defaultdict(list)
        for d, p in found:
            by[d - p].append(p)
        for begin, places in by.items():
            low = max(0, -begin)
            same = np.zeros(len(own), bool)
            part = words[begin + low : begin + len(own)]
            same[low : low + len(part)] = part == own[low : low + len(part)]
            breaks = np.append(0, np.cumsum(~same))
            fits = np.flatnonzero((breaks[size:] == breaks[:-size]) & ~tells)
            reached = np.isin(breaks[fits], [breaks[p] for p in places if breaks[p] == breaks[p + size]])
            found |= {(begin + p, p): None for p in fits[reached].tolist()}

    def _best(self, found: list[tuple[int, int]], literal: np.ndarray, least: float) -> tuple[int, float, int, bool] | None:
        """What the best occurrence covers. Slots are judged in all places together and, unless these agree, in each alignment and in alignments near one another."""
        measured, agree = self._measure(found, literal)
        if not agree:
            by: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for d, p in found:
                by[d - p].append((d, p))
            begins = sorted(by)
            near = [[]]
            for a, b in zip([begins[0], *begins], begins, strict=False):
                if b - a > len(self.words) // 2:
                    near.append([])
                near[-1] += by[b]
            measured = max([measured, *(self._measure(x, literal)[0] for x in [*by.values(), *near])], key=lambda m: (m[1], not m[3], m[0]))
        return measured if measured[0] and measured[1] >= least else None

    def _measure(self, found: list[tuple[int, int]], literal: np.ndarray) -> tuple[tuple[int, float, int, bool], bool]:
        """Windows, share, slots and whether a slot is filled otherwise, in windows whose slots hold what most have; and whether all do."""
        there, kinds, size = self.literal, self.kind, self.size
        votes: dict[tuple[int, int], Counter] = defaultdict(Counter)
        for d, p in found:
            for j in range(size):
                if kinds[p + j] != LITERAL:
                    votes[int(kinds[p + j]), int(there[p + j])][int(literal[d + j])] += 1
        stands = {k: min(c, key=lambda v: (-c[v], v)) for k, c in votes.items()}
        good = [(d, p) for d, p in found if all(kinds[p + j] == LITERAL or stands[int(kinds[p + j]), int(there[p + j])] == int(literal[d + j]) for j in range(size))]
        covered = np.zeros(len(there), bool)
        for _, p in good:
            covered[p : p + size] = True
        slots = {(int(k), int(v)) for k, v in zip(kinds[covered], there[covered], strict=True) if k != LITERAL}
        return (len(good), float(covered.mean()), len(slots), any(stands[s] != s[1] for s in slots)), len(good) == len(found)


class Document:
    """A document's template and, by size, its windows."""

    def __init__(self, text: bytes, known: Words):
        self.words, self.literal, self.kind, _ = templates([text], known)
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def having(self, size: int, by: int, wanted: np.ndarray) -> list[tuple[int, np.uint64]]:
        """Places and hashes of the windows that are among the wanted."""
        if (size, by) not in self.held:
            h = window_hashes(self.literal if by == VERBATIM else self.words, {size})[size] ^ SALT[by]
            at = np.flatnonzero(enough(self.kind, size)) if by == TELLS else np.arange(len(h))
            self.held[size, by] = h[at], at
        h, at = self.held[size, by]
        good = np.flatnonzero(np.isin(h, wanted))
        return list(zip(at[good].tolist(), h[good], strict=True))


def cell(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """One of the bits that each hash sets."""
    step = hashes >> np.uint64(32) | np.uint64(1)
    return ((hashes + np.uint64(probe) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) & (bits - 1)


def may_be(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of the hashes all of whose bits are set."""
    at = np.arange(len(hashes))
    for i in range(PROBES):
        place = cell(hashes[at], i, 8 * len(table))
        at = at[table[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0]
    return at


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """item, size, by, hash of each window of the items by which it is looked up. items: item (a digest of the row), text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            known.forget()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                item = Item(text, window, known)
                for by, h, _ in item.entries():
                    h = np.unique(h)
                    yield pa.record_batch([pa.array([key] * len(h), pa.binary()), pa.array([item.size] * len(h), pa.int32()), pa.array([by] * len(h), pa.int32()), pa.array(h.view(np.int64))], ["item", "size", "by", "hash"])

    return items.select("item", "text").mapInArrow(work, "item binary, size int, by int, hash long")


def bitmap(windows: DataFrame, n: int) -> np.ndarray:
    """The bits of all hashes, eight to a byte: at most MOST_BITS of them, whatever the benchmark's size."""
    bits = int(min(MOST_BITS, max(1 << 13, 1 << (BITS_EACH * n - 1).bit_length())))
    piece = bits // 8 // PIECES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for i in range(PROBES):
                at = cell(batch.column(0).to_numpy().view(np.uint64), i, bits)
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.record_batch([pa.array(range(PIECES), pa.int32()), pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in np.split(own, PIECES)], pa.binary())], ["piece", "bits"])

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(piece, np.uint8)
        for batch in tables:
            for x in batch.column(1):
                total |= np.frombuffer(pa.decompress(x.as_py(), piece, codec="zstd", asbytes=True), np.uint8)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "bits"])

    parts = max(1, min(64, n >> 16))
    found = windows.select("hash").coalesce(parts).mapInArrow(work, "piece int, bits binary").groupBy("piece").applyInArrow(add, "piece int, bits binary").collect()  # MOST_BITS at most
    return np.frombuffer(b"".join(bytes(r["bits"]) for r in sorted(found)), np.uint8)


def candidates(docs: DataFrame, shared: Broadcast, lookups: list[tuple[int, int]]) -> DataFrame:
    """row, doc_id, text and hashes (of windows that may be the benchmark's) of the documents that have some. shared: their bitmap; lookups: what by and of what size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value, Words()
        by_template, by_literal = ({s for b, s in lookups if (b == VERBATIM) == v} for v in (False, True))
        for batch in by_bytes(batches, 2, 6 * BATCH):
            known.forget()
            t = templates(batch.column(2).to_pylist(), known)
            hashes = {False: window_hashes(t.words, by_template), True: window_hashes(t.literal, by_literal)}
            found, owners = [], []
            for by, size in lookups:
                h = hashes[by == VERBATIM][size]
                at = np.flatnonzero(t.of[: len(h)] == t.of[size - 1 :])
                if by != VERBATIM and len(h):
                    tells = enough(t.kind, size)
                    at = at[tells[at] if by == TELLS else ~tells[at]]
                h = h[at] ^ SALT[by]
                may = may_be(h, table)
                found.append(h[may])
                owners.append(t.of[at[may]])
            h, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, owners))
            own = np.unique(owner)
            lists = [np.unique(h[owner == i]).view(np.int64) for i in own.tolist()]
            taken = batch.take(pa.array(own, pa.int64()))
            yield pa.record_batch([*taken.columns, pa.array(lists, pa.list_(pa.int64()))], ["row", "doc_id", "text", "hashes"])

    return docs.select(row_digest().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(frugal(work), "row binary, doc_id long, text binary, hashes array<long>")


def matched_rows(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, least_covered: float = LEAST_COVERED) -> DataFrame:
    """row (of common.row_digest), doc_id, item_id, n_windows, covered, n_slots, reparameterised of each pair of different rows that match."""
    schema = "row binary, doc_id long, item_id long, n_windows long, covered double, n_slots long, reparameterised boolean"
    items = benchmark.select(row_digest("item_id").alias("item"), F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("item_text")).dropDuplicates(["item"])
    items = scratch.cut(items)
    windows = scratch.cut(benchmark_windows(items.withColumnRenamed("item_text", "text"), window))
    n = windows.count()
    lookups = sorted((r["by"], r["size"]) for r in windows.select("by", "size").distinct().collect())  # a few for each size up to a window
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(windows, n))
    found = scratch.cut(candidates(docs, shared, lookups), "zstd")
    shared.unpersist()
    small = F.broadcast if n <= FEW_ROWS else lambda df: df
    light = F.broadcast if items.agg(F.sum(F.octet_length("item_text"))).first()[0] <= FEW_BYTES else lambda df: df
    held = windows.select("item", "hash").distinct()
    hits = found.select("row", F.explode("hashes").alias("hash"))
    per = held.groupBy("hash").agg(F.count("*").alias("of")).join(hits.groupBy("hash").agg(F.count("*").alias("met")), "hash").select("hash", (F.col("of") * F.col("met")).alias("often"))
    often = held.join(per, "hash").groupBy("item").agg(F.collect_list(F.struct("hash", "often")).alias("often"))  # as many as the item has windows

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            known.forget()
            for item, text, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = Item(text, window, known).keys({x["hash"]: x["often"] for x in seen}, least_covered)
                yield pa.record_batch([pa.array([item] * len(keys), pa.binary()), pa.array(keys, pa.int64())], ["item", "hash"])

    keys = scratch.cut(items.join(often, "item").select("item", "item_text", "often").mapInArrow(frugal(choose), "item binary, hash long"))
    pairs = scratch.cut(hits.join(small(keys), "hash").select("row", "item").distinct())
    parts = pairs.groupBy("row").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    dealt = pairs.join(parts, "row").select("row", "item", F.pmod(F.xxhash64("item"), F.col("parts")).alias("part")).join(light(items), "item")
    dealt = scratch.cut(dealt.groupBy("row", "part").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items")), "zstd")
    met = dealt.join(found.select("row", "doc_id", "text").dropDuplicates(["row"]), "row").select("row", "doc_id", "text", "items")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            known.forget()
            out = []
            for i in range(batch.num_rows):
                row, doc_id, text, own = (c[i].as_py() for c in batch.columns)
                doc = Document(text, known)
                for x in own:
                    if m := Item(x["item_text"], window, known).match(doc, least_covered):
                        out.append((row, doc_id, x["item_id"], *m))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])

    return scratch.cut(met.mapInArrow(frugal(work), schema))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_covered: float = LEAST_COVERED) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: at least least_covered of the item's words lie in shared windows.

    docs: doc_id, text; benchmark: item_id, text. Returns doc_id, item_id, n_windows, covered (share of the
    item's words), n_slots (different slot values in them) and reparameterised (a slot has another value here), one row a pair; of rows
    that repeat a doc_id or an item_id the best match counts: the most covered, then the most windows, then the most slots. Null and empty texts match nothing; windows of too few
    literal words match as the module text says, an item of fewer than LEAST_LITERAL of them word for word only; an item shorter than a window is one window; whole texts
    are read whatever their length, each in one task; null ids are reported as null; empty tables give an
    empty result; other columns aren't read."""
    rows = matched_rows(docs, benchmark, Scratch(docs.sparkSession), window, least_covered)
    best = F.max(F.struct("covered", "n_windows", "n_slots", "reparameterised")).alias("best")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_windows", "best.covered", "best.n_slots", "best.reparameterised")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns. Each row is judged by its own text, whatever its id."""
    (row,) = fresh(docs, "row")
    held = matched_rows(docs, benchmark, Scratch(docs.sparkSession), **how).select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, row_digest()).join(held, row, "left_anti").select(*quoted(docs.columns))
