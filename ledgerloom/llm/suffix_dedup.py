"""Removal of byte strings that another document already has, by suffix arrays.

A byte goes if a string of L = 50 bytes that covers it also starts in a document with a smaller id. Equal
strings must meet in one task before they can be sorted side by side, so each string is routed by the
least hash of its 16-byte grams: equal strings have equal keys, and neighbouring starts mostly share one,
so a stretch of starts travels as one window of text. Steps, all over texts dealt to parts by doc_id:

1. Each part tells the keys of its windows; a bucket of keys answers with those that two documents have.
2. Each part sends its distinct windows that have such keys, with the smallest and largest doc_id there.
3. Each bucket sorts the starts of its windows with a two-stage suffix sort and takes the common prefixes
   of neighbours; starts that agree in L bytes form a group, whose smallest doc_id goes back to the parts.
4. Each part marks what is covered and cuts it from its texts.

A part sends a window once, however many of its documents have it, so a passage that a third of all
documents share costs one entry a part. Buckets hold keys of about one part's text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import find, from_planes, known_id, parts_for, planes, runs_of, text_bytes, total_bytes

LENGTH, GRAM = 50, 16
PART_BYTES = 4 << 20
#: Starts whose keys are held at once.
BLOCK = 1 << 19
#: A longer stretch of starts with one key is cut here.
LONGEST = 4096

#: Bits of a key that parts and buckets speak of; a key is only a meeting point, so fewer bits cost no exactness.
KEY_BITS = 48
WINDOW = np.dtype([("key", "<u8"), ("least", "<i8"), ("beyond", "<i8"), ("starts", "<u2")])  # beyond: the largest doc_id less the smallest
ANSWER = np.dtype([("key", "<u8"), ("hash", "<u8"), ("least", "<i8"), ("from", "<u2"), ("to", "<u2")])


def words64(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place, as little-endian integers."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for s in range(min(8, len(out))):
        m = (len(data) - s) // 8
        out[s::8] = data[s : s + 8 * m].copy().view("<u8")
    return out


def start_keys(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each start of a string of `length` bytes the least hash of the grams inside."""
    w = words64(data)
    h = w[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += w[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    grams, have = length - GRAM + 1, 1
    while have < grams:
        step = min(have, grams - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def windows(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of starts with one key: key, document's place in texts, first start within it, number of starts.

    They depend on the document alone: not on what stands beside it, nor on where a block begins, as rows may come in another order next time."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    stops = np.maximum(ends - length + 1, begins)  # one past the last start
    keys, places = [], []
    n = len(data) - length + 1
    before = None
    for at in range(0, max(n, 0), BLOCK):
        k = start_keys(data[at : min(at + BLOCK, n) + length - 1], length)
        cut = np.concatenate([b[np.searchsorted(b, at) : np.searchsorted(b, at + len(k))] for b in (begins, stops)])
        change = np.zeros(len(k), bool)
        change[0] = before is None or k[0] != before
        change[1:] = k[1:] != k[:-1]
        before = k[-1]
        change[cut - at] = True
        first = np.flatnonzero(change)
        keys.append(k[first] >> np.uint64(64 - KEY_BITS))
        places.append(first + at)
    if not keys:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    key, place = np.concatenate(keys), np.concatenate(places)
    count = np.append(place[1:], n) - place
    doc = np.searchsorted(ends, place, side="right")
    ok = place < stops[doc]
    key, place, count, doc = key[ok], place[ok], count[ok], doc[ok]
    if len(count) and count.max() > LONGEST:
        more = -(-count // LONGEST)
        turn = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        key, doc = np.repeat(key, more), np.repeat(doc, more)
        place, count = np.repeat(place, more) + turn * LONGEST, np.minimum(np.repeat(count, more) - turn * LONGEST, LONGEST)
    return key, doc, place - begins[doc], count


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64) % buckets


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from one to the next, whose high bytes are mostly zero."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64)


def _split(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """values by at: the different at, and the values of each."""
    order = np.argsort(at, kind="stable")
    at, values = at[order], values[order]
    starts = runs_of(at)
    return at[starts], np.split(values, starts[1:]) if len(starts) else []


def ask(table: pa.Table, buckets: int, length: int = LENGTH) -> pa.Table:
    """Step 1 in a part: the different keys of its windows by bucket; those that two of its documents have come apart."""
    ids, texts = np.array(_column(table, "did"), np.int64), _column(table, "text")
    key, doc, _, _ = windows(texts, length)
    owner = ids[doc]
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    s = runs_of(key)
    key, several = key[s], np.minimum.reduceat(owner, s) != np.maximum.reduceat(owner, s) if len(s) else np.zeros(0, bool)
    out = []
    for flag in (False, True):
        at, lists = _split(key[several == flag], _bucket(key[several == flag], buckets))
        out += [(int(b), flag, _steps(x)) for b, x in zip(at, lists, strict=True)]
    part = table.column("part")[0].as_py() if table.num_rows else 0
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "part": pa.array([part] * len(out), pa.int64()), "several": pa.array([x[1] for x in out], pa.bool_()), "keys": pa.array([x[2] for x in out], pa.binary())})


def tell(table: pa.Table) -> pa.Table:
    """Step 1 in a bucket: for each part those of its keys that two documents have."""
    lists = [_keys(x) for x in _column(table, "keys")]
    sizes = [len(x) for x in lists]
    key, part = np.concatenate(lists), np.repeat(_column(table, "part"), sizes)
    several = np.repeat(_column(table, "several"), sizes)
    order = np.argsort(key)
    key, part, several = key[order], part[order], several[order]
    s = runs_of(key)
    shared = (np.diff(np.append(s, len(key))) > 1) | np.logical_or.reduceat(several, s)
    keep = np.repeat(shared, np.diff(np.append(s, len(key))))
    parts, keys = _split(key[keep], part[keep])
    return pa.table({"part": pa.array(parts, pa.int64()), "keys": pa.array([_steps(x) for x in keys], pa.binary())})


def send(docs: pa.Table, told: pa.Table, buckets: int, length: int = LENGTH) -> pa.Table:
    """Step 2 in a part: its distinct windows with keys that two documents have, by bucket."""
    out: list[tuple[int, bytes, bytes]] = []
    part = 0
    if docs.num_rows and told.num_rows:
        part = docs.column("part")[0].as_py()
        ids, texts = np.array(_column(docs, "did"), np.int64), _column(docs, "text")
        known = np.sort(np.concatenate([_keys(x) for x in _column(told, "keys")]))
        key, doc, start, count = windows(texts, length)
        keep = find(key, known) >= 0
        key, doc, start, count = key[keep], doc[keep], start[keep], count[keep]
        at, rows = _split(np.arange(len(key)), _bucket(key, buckets))
        digest = xxhash.xxh3_64_intdigest
        for b, own in zip(at.tolist(), rows, strict=True):
            seen: dict[int, list] = {}
            for k, d, s, c, i in zip(key[own].tolist(), doc[own].tolist(), start[own].tolist(), count[own].tolist(), ids[doc[own]].tolist(), strict=True):
                text = texts[d][s : s + c + length - 1]
                if was := seen.get(h := digest(text)):
                    was[0], was[1] = min(was[0], i), max(was[1], i)
                else:
                    seen[h] = [i, i, k, c, text]
            head = np.array([(k, a, z - a, c) for a, z, k, c, _ in seen.values()], WINDOW)
            out.append((b, planes(head), pa.compress(b"".join(x[4] for x in seen.values()), codec="zstd", asbytes=True)))
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "part": pa.array([part] * len(out), pa.int64()), "head": pa.array([x[1] for x in out], pa.binary()), "bytes": pa.array([x[2] for x in out], pa.binary())})


def big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as integers that compare like them; zeros follow the last byte."""
    return words64(np.concatenate([data, np.zeros(72, np.uint8)])).byteswap()


def suffix_sort(data: np.ndarray, words: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The wanted starts in the order of their suffixes, to a depth of `length` bytes at least (two-stage sorting).

    Suffixes smaller than their successors ("rising") are sorted directly. The others ("falling") are placed
    by scanning the buckets of first bytes upwards: a falling suffix comes in its bucket in the order of the
    suffix one byte later, which is smaller and so already placed. wanted: bool for each place; of the other
    places only those are sorted from which wanted ones are placed."""
    n = len(data)
    step = data[1:].astype(np.int16) - data[:-1]
    changes = np.flatnonzero(step)  # equal bytes take the type of what follows; the last suffix falls
    rising = np.zeros(n, bool)
    rising[: changes[-1] + 1 if len(changes) else 0] = np.repeat(step[changes] > 0, np.diff(np.append(-1, changes)))
    # a falling suffix is placed from its successor, so what is wanted reaches up to the next rising one
    stops = np.append(np.flatnonzero(rising), n - 1)
    at = np.flatnonzero(wanted)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, stops[np.minimum(np.searchsorted(stops, at), len(stops) - 1)] + 1, -1)
    used = np.cumsum(edge[:n]) > 0

    direct = _sorted_by_text(words, np.flatnonzero(used & rising), length)
    falls = used & ~rising
    rises_from = np.searchsorted(data[direct], np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and falls[n - 1]:
        heads[data[n - 1]].append(np.array([n - 1]))

    def induce(placed: np.ndarray, low: int) -> np.ndarray:
        """Give what precedes the placed suffixes to their buckets; returns those of bucket low itself."""
        before = placed - 1
        before = before[(before >= 0) & falls[before]]
        c = data[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
        s = runs_of(c)
        own = before[:0]
        for v, x in zip(c[s].tolist(), np.split(before, s[1:]) if len(s) else [], strict=True):
            if v == low:
                own = x
            else:
                heads[v].append(x)
        return own

    out = [direct[:0]]
    for c in range(256):
        turn = np.concatenate([direct[:0], *heads[c]])
        while len(turn):  # a run of equal bytes gives its own bucket one more each time
            out.append(turn)
            turn = induce(turn, c)
        rises = direct[rises_from[c] : rises_from[c + 1]]
        induce(rises, c)
        out.append(rises)
    array = np.concatenate(out)
    return array[wanted[array]]


def _sorted_by_text(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Places sorted by the text that starts there, to `length` bytes: eight bytes at a time, and then only what still ties."""
    key = words[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    tied, group = _ties(key, np.zeros(len(at), np.int32))
    for depth in range(8, length, 8):
        if not len(tied):
            break
        key = words[np.minimum(at[tied] + depth, len(words) - 1)]
        order = np.lexsort((key, group))
        at[tied], key = at[tied][order], key[order]
        keep, group = _ties(key, group)
        tied = tied[keep]
    return at


def _ties(key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys sorted within groups: the places that tie with a neighbour, and the numbers of their new groups."""
    if not len(key):
        return np.zeros(0, np.int64), group
    new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
    alone = new & np.append(new[1:], True)
    return np.flatnonzero(~alone), np.cumsum(new, dtype=np.int32)[~alone]


def common_prefixes(words: np.ndarray, array: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix of the array shares with the one before it, counted to `length`; the first has 0."""
    common = np.zeros(len(array), np.int64)
    live = np.arange(1, len(array))
    for depth in range(0, length, 8):
        differ = words[np.minimum(array[live] + depth, len(words) - 1)] ^ words[np.minimum(array[live - 1] + depth, len(words) - 1)]
        common[live] = depth + sum((differ >> np.uint64(8 * j)) == 0 for j in range(8))
        live = live[differ == 0]
    return np.minimum(common, length)


def meet(table: pa.Table, length: int = LENGTH) -> pa.Table:
    """Step 3: by suffix array, for each window the smallest doc_id that has the string at each start."""
    heads = [from_planes(x, WINDOW) for x in _column(table, "head")]
    head, part = np.concatenate(heads), np.repeat(_column(table, "part"), [len(x) for x in heads])
    starts = head["starts"].astype(np.int64)
    size = starts + length - 1
    text_at = np.cumsum(size) - size
    sizes = [int(x.sum()) for x in np.split(size, np.cumsum([len(x) for x in heads])[:-1])]
    raw = b"".join(pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(_column(table, "bytes"), sizes, strict=True))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(raw[a:b]) for a, b in zip(text_at.tolist(), (text_at + size).tolist(), strict=True)], np.uint64)
    text = np.frombuffer(raw, np.uint8)
    # one copy of each window is sorted
    order = np.argsort(hashes, kind="stable")
    s = order[runs_of(hashes[order])]
    which = np.searchsorted(hashes[s], hashes)
    least = np.full(len(s), np.iinfo(np.int64).max)
    np.minimum.at(least, which, head["least"])
    starts, size = starts[s], size[s]
    begins = np.cumsum(size) - size
    data = text[np.repeat(text_at[s] - begins, size) + np.arange(int(size.sum()))]
    del raw, text
    turn = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    place = np.repeat(begins, starts) + turn
    of = np.repeat(np.arange(len(s)), starts)
    wanted = np.zeros(len(data), bool)
    wanted[place] = True

    words = big_endian(data)
    array = suffix_sort(data, words, wanted, length)
    first = np.flatnonzero(common_prefixes(words, array, length) < length)
    found = np.zeros(len(data), np.int64)
    found[place] = least[of]
    found[array] = np.repeat(np.minimum.reduceat(found[array], first), np.diff(np.append(first, len(array))))
    low = found[place]  # by window and start
    # stretches of starts with one answer
    cut = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (of[1:] != of[:-1])))
    run_of, run_low, run_from = of[cut], low[cut], turn[cut]
    run_to = run_from + np.diff(np.append(cut, len(low)))
    by_window = np.searchsorted(run_of, np.arange(len(s) + 1))
    # each part gets the stretches of its windows that some document of its own has to give up
    many = by_window[which + 1] - by_window[which]
    row = np.repeat(np.arange(len(head)), many)
    run = np.repeat(by_window[which], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    keep = run_low[run] < (head["least"] + head["beyond"])[row]
    row, run = row[keep], run[keep]
    answer = np.zeros(len(row), ANSWER)
    answer["key"], answer["hash"], answer["least"], answer["from"], answer["to"] = head["key"][row], hashes[row], run_low[run], run_from[run], run_to[run]
    parts, lists = _split(answer, part[row])
    return pa.table({"part": pa.array(parts, pa.int64()), "answers": pa.array([planes(x) for x in lists], pa.binary())})


def covered(docs: pa.Table, answers: pa.Table, length: int = LENGTH) -> list[np.ndarray]:
    """For each text of a part the removed runs, as rows of begin and end."""
    ids, texts = np.array(_column(docs, "did"), np.int64), _column(docs, "text")
    none = np.zeros((0, 2), np.int64)
    if not answers.num_rows:
        return [none] * len(texts)
    answer = np.concatenate([from_planes(x, ANSWER) for x in _column(answers, "answers")])
    key, doc, start, count = windows(texts, length)
    keep = find(key, np.unique(answer["key"])) >= 0
    doc, start, count = doc[keep], start[keep], count[keep]
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(texts[d][s : s + c + length - 1]) for d, s, c in zip(doc.tolist(), start.tolist(), count.tolist(), strict=True)], np.uint64)
    answer = answer[np.argsort(answer["hash"], kind="stable")]
    low, high = np.searchsorted(answer["hash"], hashes), np.searchsorted(answer["hash"], hashes, side="right")
    row = np.repeat(np.arange(len(hashes)), high - low)
    of = np.repeat(low, high - low) + np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    goes = answer["least"][of] < ids[doc[row]]
    row, of = row[goes], of[goes]
    runs = np.stack([start[row] + answer["from"][of], start[row] + answer["to"][of] + length - 1], axis=1)
    order = np.lexsort((runs[:, 0], doc[row]))
    runs, owner = runs[order], doc[row][order]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [merged(runs[a:b]) if b > a else none for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def merged(runs: np.ndarray) -> np.ndarray:
    """Runs sorted by begin, with those joined that overlap or touch."""
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.flatnonzero(np.append(True, runs[1:, 0] > reach[:-1]))
    return np.stack([runs[new, 0], np.append(reach[new[1:] - 1], reach[-1])], axis=1)


def cut_out(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, part_bytes: int = PART_BYTES) -> DataFrame:
    """Texts without the bytes that a document with a smaller id has in a string of `length` bytes.

    docs: doc_id, text. Returns a row for each: doc_id, n_bytes, spans (array of begin, end in bytes of
    what is removed, in order, apart from one another) and kept (the remaining bytes, which may end or begin
    within a character). What is removed is judged on the input. Null and empty texts have nothing to
    remove and keep nothing; texts under `length` bytes stay whole; rows with one doc_id don't count against each other;
    a null doc_id counts as the largest id; an empty table gives an empty result; other columns aren't read."""
    spark = docs.sparkSession
    parts = parts_for(spark, total_bytes(docs), part_bytes)
    dealt = docs.select(F.col("doc_id").cast("long"), known_id().alias("did"), text_bytes().alias("text"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("did"), F.lit(parts)))

    asked = dealt.groupBy("part").applyInArrow(lambda t: ask(t, parts, length), "bucket long, part long, several boolean, keys binary")
    told = asked.groupBy("bucket").applyInArrow(tell, "part long, keys binary")
    sent = dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(lambda d, t: send(d, t, parts, length), "bucket long, part long, head binary, bytes binary")
    met = sent.groupBy("bucket").applyInArrow(lambda t: meet(t, length), "part long, answers binary")

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        runs = covered(table, answers, length) if table.num_rows else []
        texts = _column(table, "text")
        spans = pa.array([[{"begin": a, "end": b} for a, b in r.tolist()] for r in runs], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        kept = pa.array([cut_out(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary())
        return pa.table({"doc_id": table.column("doc_id") if table.num_rows else pa.array([], pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "spans": spans, "kept": kept})

    return dealt.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
