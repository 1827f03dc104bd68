"""Removal of repeated runs of lines: every window of three consecutive lines that came before, anywhere, goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import known_id

WINDOW = 3


def remove_repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Texts without the lines of windows that occur earlier, in order of doc_id and then of place.

    docs: doc_id, text. Lines are what \\n parts; a window is `window` consecutive lines, compared exactly.
    The first occurrence of a window stays; lines that any later occurrence covers go. Returns a row for
    each: doc_id, n_lines, removed (sorted line numbers from 0) and text (the other lines, joined by \\n).
    A text with fewer lines than a window is one window, which only a whole text can repeat. A null text has no lines and stays null; empty
    texts stay as they are; whole texts count whatever their length; a null doc_id comes after all others; rows that repeat both id and text get
    the same result, and rows with one id and different texts are ordered by a hash of the text; an empty
    table gives an empty result; other columns aren't read.

    Built-in functions only. Windows travel as 16-byte digests; the first place of each is found by an
    aggregate with partial sums, and the places join it on the digest, where AQE can split a digest that
    a large share of all places have."""
    lined = docs.select(F.col("doc_id").cast("long"), known_id().alias("did"), F.xxhash64("text").alias("row"), F.split("text", "\n").alias("lines"))
    marks = F.transform(F.sequence(F.lit(1), F.greatest(F.size("lines") - (window - 1), F.lit(1))), lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, window), "\n").cast("binary"))))
    places = lined.where((F.size("lines") > 1) | (F.get("lines", F.lit(0)) != "")).select("did", "row", F.posexplode(marks).alias("pos", "mark"))
    first = places.groupBy("mark").agg(F.min(F.struct("did", "row", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("mark", "first")
    later = places.join(first, "mark").where(F.struct("did", "row", "pos") > F.col("first"))
    covered_lines = later.groupBy("did", "row").agg(F.collect_set("pos").alias("at"))
    covered_lines = covered_lines.select("did", "row", F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (window - 1))))).alias("removed"))
    n = F.greatest(F.size("lines"), F.lit(0))
    covered = F.filter(F.sort_array("removed"), lambda i: i < n)  # a short text ends before its window does
    out = lined.join(covered_lines, ["did", "row"], "left").withColumn("removed", F.coalesce(covered, F.array().cast("array<int>")))
    left = F.when(n > 0, F.array_except(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), "removed"))
    kept = F.when(F.size("removed") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return out.select("doc_id", n.alias("n_lines"), "removed", kept.alias("text"))
