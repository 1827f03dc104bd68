"""Quality grades by ordinal regression: a cumulative-link model over hashed words.

P(grade > k) = sigmoid(score - t_k) with one score for all grades, the sum of a text's feature weights,
and ordered thresholds t_0 < t_1 < ..; a document is taken if its probability of the highest grade is at
least a tail, which is chosen on labelled rows held out from the fit. Features are the presence of words, of their beginnings and of what they end with, and how
varied the words are for their number, hashed to 2^18 places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_bytes

PLACES = 1 << 18
#: Labelled rows that the model is fitted on, at most.
MAX_TRAIN = 20_000
ROUNDS, RATE, DAMP, L1, LEAST_DOCS = 150, 0.1, 1e-4, 0.0004, 3
#: A document is taken if its probability of the highest grade is at least the tail: that of these which judges held-out rows best, or
#: the first where there are none to judge.
TAILS = (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7, 0.25, 0.75, 0.2, 0.8, 0.15, 0.85, 0.1, 0.9)
#: One in so many labelled rows is held out for that.
HELD_OUT = 5
HELD = 1 << 20


class _Features(dict):
    """Of a word: without the marks around it in lower case, that word's first six characters, and its last two bytes as they are."""

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        if len(self) > HELD:
            self.clear()
        core = word.strip(b".,;:!?\"'()[]").decode("utf-8", "replace").lower()
        self[word] = found = tuple(xxhash.xxh32_intdigest(x, i) % PLACES for i, x in enumerate((core, core[:6], word[-2:])))
        return found


def features(text: bytes, known: _Features) -> np.ndarray:
    """The places of a text's features, each once."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32)
    different = set(words)
    variety = xxhash.xxh32_intdigest(f"{10 * len(different) // len(words)} {min(len(words).bit_length(), 12)}", 3) % PLACES
    return np.unique(np.array([variety, *(f for w in different for f in known[w])], np.int32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def slopes(scores: np.ndarray, t: np.ndarray, grades: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By how much the sum of weight times -log P(grade) grows with each row's score, and with each threshold."""
    n = len(scores)
    # P(g) = s(score - t[g-1]) - s(score - t[g])
    above = np.concatenate([np.ones((n, 1)), _sigmoid(scores[:, None] - t[None, :]), np.zeros((n, 1))], axis=1)
    at = np.arange(n)
    p = np.maximum(above[at, grades] - above[at, grades + 1], 1e-9)
    d = above * (1 - above)
    low, high = weight * d[at, grades] / p, weight * d[at, grades + 1] / p
    return high - low, np.array([low[grades == k + 1].sum() - high[grades == k].sum() for k in range(len(t))])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised loss, by proximal steps of Adagrad over all rows."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows)), sizes)
    often = np.bincount(at, minlength=PLACES) >= LEAST_DOCS
    at, row = at[often[at]], row[often[at]]
    used, at = np.unique(at, return_inverse=True)
    w, seen = np.zeros(len(used)), np.full(len(used), DAMP)
    t = np.linspace(-1, 1, n_grades - 1)
    t_seen = np.full(n_grades - 1, 1e-8)
    n = max(1, len(rows))
    counts = np.bincount(grades, minlength=n_grades)
    weight = (n / (n_grades * np.maximum(counts, 1)))[grades]  # each grade counts alike
    for _ in range(ROUNDS):
        slope, t_slope = slopes(np.bincount(row, w[at], minlength=n), t, grades, weight)
        g = np.bincount(at, slope[row], minlength=len(used)) / n
        seen += g * g
        rate = RATE / np.sqrt(seen)
        w -= rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        t_seen += (t_slope / n) ** 2
        t = np.sort(t - 0.1 * RATE * (t_slope / n) / np.sqrt(t_seen))
    full = np.zeros(PLACES)
    full[used] = w
    return full, t


def sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text and grade of the labelled rows to fit on: at most about max_train of them, by a hash of the id.

    Grade 0 is toxic, 1 of low quality, 2 neither. Of several labels of an id the worst counts; labels without an id or without both judgements aren't used."""
    grade = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))
    n = graded.count()
    some = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_train / max(1, n))))
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).join(some, "doc_id")


def score(row: np.ndarray, weights: np.ndarray) -> float:
    return float(weights[row].sum())


def best_tail(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> float:
    """The tail by which a model fitted without every HELD_OUT-th row judges these rows best: by the mean, over the grades, of the share that
    is taken of the highest and left of the others."""
    held = np.arange(len(rows)) % HELD_OUT == 0
    if not held.any() or held.all():
        return TAILS[0]
    weights, t = fit([r for r, h in zip(rows, held, strict=True) if not h], grades[~held], n_grades)
    tail = _sigmoid(np.array([score(r, weights) for r, h in zip(rows, held, strict=True) if h]) - t[-1])
    own = grades[held]
    right = [np.mean([((tail >= x) == (k == n_grades - 1))[own == k].mean() for k in np.unique(own)]) for x in TAILS]
    return TAILS[int(np.argmax(right))]


def train(rows: DataFrame, n_grades: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, thresholds and the tail, fitted in one task on the features of a bounded sample; without rows all weights are zero."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for batch in batches:
            ids = [features(t, known).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], ["doc_id", "ids", "grade"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        ids, grades = [np.frombuffer(x, np.int32) for x in table.column("ids").to_pylist()], table.column("grade").to_numpy()
        w, t = fit(ids, grades, n_grades)
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array(np.concatenate([at, np.full(len(t), -1), [-2]]), pa.int64()), "value": pa.array(np.concatenate([w[at], t, [best_tail(ids, grades, n_grades)]]), pa.float64())})

    got = rows.select("doc_id", "text", F.col("grade").cast("int")).mapInArrow(reduce, "doc_id long, ids binary, grade int").groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: learn(t), "at long, value double").collect()
    w = np.zeros(PLACES)
    for r in got:
        if r["at"] >= 0:
            w[r["at"]] = r["value"]
    tail = next((r["value"] for r in got if r["at"] == -2), TAILS[0])
    return w, np.array(sorted(r["value"] for r in got if r["at"] == -1) or [0.0] * (n_grades - 1)), tail


def grade(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray, tail: float = TAILS[0]) -> DataFrame:
    """expected_grade, tail_probability (of the highest grade) and selected for each row.

    docs: doc_id, text. Null and empty texts have no features and the probabilities of a score of zero; whole texts
    count whatever their length, each in one task; a probability equal to the tail is enough; repeated rows and null ids are rows like others; an empty table gives an empty result; other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, thresholds))  # at most PLACES numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        known = _Features()
        for batch in batches:
            scores = np.array([score(features(x, known), w) for x in batch.column(1).to_pylist()])
            above = _sigmoid(scores[:, None] - t[None, :]) if len(scores) else np.zeros((0, len(t)))
            yield pa.record_batch([batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, -1])], ["doc_id", "expected_grade", "tail_probability"])

    out = docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(work, "doc_id long, expected_grade double, tail_probability double")
    return out.withColumn("selected", F.col("tail_probability") >= tail)


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """grade() of all docs by a model fitted on their labels (doc_id, quality, toxic)."""
    return grade(docs, *train(sample(docs, labels, max_train)))
