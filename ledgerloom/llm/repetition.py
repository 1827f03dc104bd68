"""Quality rules on repetition inside a text, by a suffix array of its words.

Many texts are sorted at once: the array of a batch holds the suffixes of each text, in words, one text
after another. Neighbours in the array with a longest common prefix of n words are two places of one
repeated stretch; every suffix stands in the LCP interval of the longest stretch that repeats from its
place on, and the union of these stretches over all places is the union of all maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_bytes, frugal, text_bytes

MIN_WORDS, MAX_REPEAT_PERCENT, NGRAM = 50, 50, 3
#: Words from which on a repeat counts; the covered share of words and the longest repeat that a text may have.
REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.3, 100
#: Words that are sorted at once; a longer text is sorted alone.
BATCH = 1 << 18
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest long"


class _Ids(dict):
    """A new number for each new word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of all texts, sorted by text and then by words, and for k = 0, 1.. ranks by the first 2^k words.

    ids: word numbers, text after text; ends: for each word where its text ends. Ranks of 2^k words come from
    those of 2^(k-1); only suffixes that still tie are sorted again. A suffix ends with its text."""
    n = len(ids)
    key = ends.astype(np.int64) << 32 | ids
    array = np.argsort(key, kind="stable")
    key = key[array]
    new = np.append(True, key[1:] != key[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[array] = start
    ranks = [rank.astype(np.int32)]
    live = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the array
    step = 1
    while len(live):
        at = array[live]
        then = at + step
        second = np.where(then < ends[at], rank[np.minimum(then, n - 1)] + 1, 0)
        key = rank[at] << 32 | second
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        array[live] = at
        new = np.append(True, key[1:] != key[:-1])
        start = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        rank[at] = start
        ranks.append(rank.astype(np.int32))
        live = live[~(new & np.append(new[1:], True))]
        step *= 2
    return array, ranks


def common_prefixes(array: np.ndarray, ranks: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Words that each suffix of the array shares with the one before it; 0 for the first."""
    n = len(array)
    common = np.zeros(n, np.int64)
    live = np.arange(1, n)
    live = live[ranks[0][array[live]] == ranks[0][array[live - 1]]]
    for k in range(len(ranks) - 1, -1, -1):
        a, b = array[live - 1] + common[live], array[live] + common[live]
        inside = (a < ends[array[live - 1]]) & (b < ends[array[live]])
        same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        common[live[same]] += 1 << k
    return common


def repeats(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the number of words that repeat elsewhere in its text from there on."""
    array, ranks = suffix_array(ids, ends)
    common = common_prefixes(array, ranks, ends)
    out = np.zeros(len(ids), np.int64)
    out[array] = np.maximum(common, np.append(common[1:], 0))
    return out


def spanned(lengths: np.ndarray, least: int, fixed: bool = False) -> np.ndarray:
    """Whether a word is in the union of the stretches of at least `least` words; fixed: of `least` words exactly."""
    n = len(lengths)
    reach = np.where(lengths >= least, np.arange(n) + (least if fixed else lengths), 0)
    return np.maximum.accumulate(reach) > np.arange(n)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], repeat: int = REPEAT) -> list[tuple[int, ...]]:
    """For each text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words in repeats and words of the longest repeat."""
    out: list[tuple[int, ...]] = []
    held: list[tuple[bytes, list[int]]] = []
    numbers = _Ids()

    def flush() -> None:
        sizes = np.fromiter((len(x) for _, x in held), np.int64, len(held))
        ids = np.fromiter((i for _, x in held for i in x), np.int64, int(sizes.sum()))
        ends = np.repeat(np.cumsum(sizes), sizes)
        lengths = repeats(ids, ends) if len(ids) else ids
        totals = [np.append(0, np.cumsum(x)) for x in (spanned(lengths, NGRAM, True), spanned(lengths, repeat))]
        b = np.cumsum(sizes)
        a = b - sizes
        grams, cover = ((t[b] - t[a]).tolist() for t in totals)
        longest = np.zeros(len(held), np.int64)
        if len(ids):
            longest[sizes > 0] = np.maximum.reduceat(lengths, a[sizes > 0])
        for (text, words), g, c, m in zip(held, grams, cover, longest.tolist(), strict=True):
            chars = len(text.translate(None, WHITE).decode("utf-8", "replace"))
            out.append((len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), duplicate_lines(text), g, c, m))
        held.clear()
        numbers.clear()

    size = 0
    for text in texts:
        words = text.split()
        if held and size + len(words) > BATCH:
            flush()
            size = 0
        held.append((text, list(map(numbers.__getitem__, words))))
        size += len(words)
    if held:
        flush()
    return out


def quality(docs: DataFrame, repeat: int = REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Measures of repetition and a verdict for each row.

    docs: doc_id, text. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_covered (words in maximal repeats of at least `repeat` words, the first places included), longest (words of the
    longest repeat), base_failed (too few words, or too many in repeated three-word windows) and kept:
    not base_failed, at most max_covered of the words covered, no repeat longer than max_longest.
    Null and empty texts count as texts without words, which fail; whole texts count whatever their length, one
    over BATCH words by itself; repeated rows, ties and null ids are rows like others; an empty table gives an empty result; other columns aren't read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            rows = measure(batch.column(1).to_pylist(), repeat)
            yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(7))], [c.split()[0] for c in SCHEMA.split(", ")])

    df = docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(frugal(work), SCHEMA)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = (F.col("n_covered") <= F.lit(max_covered) * F.col("n_words")) & (F.col("longest") <= max_longest)
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def passes(row: tuple[int, ...], max_covered: float, max_longest: int) -> bool:
    """Whether the measures of a text make quality() keep it."""
    n, _, _, _, repeated, covered, longest = row
    return n >= MIN_WORDS and 100 * repeated <= MAX_REPEAT_PERCENT * n and covered <= max_covered * n and longest <= max_longest


def keep_good(docs: DataFrame, repeat: int = REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, whatever these are called. Each row is judged by its own text, whatever its id, where it stands;
    rows are taken in slices of some megabytes. Null and empty texts fail; an empty table gives an empty result."""
    at, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)  # names with dots or quotes would be read as paths

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_bytes(batches, at):
            texts = some.column(at).cast(pa.binary()).to_pylist()
            good = [passes(r, max_covered, max_longest) for r in measure([t or b"" for t in texts], repeat)]
            yield some.filter(pa.array(good, pa.bool_()))

    return plain.mapInArrow(frugal(work), plain.schema).toDF(*docs.columns)
