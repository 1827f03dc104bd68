"""Each operator against a brute-force version, on small tables with the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import chunk_dedup, decontaminate, html_extract, jaccard, kdshard, line_dedup, mixing, ordinal, repetition, simhash, suffix_dedup

WORDS = [f"{a}{b}" for a in "ka lo mi su te ra no".split() for b in "n r s t l m v z d".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, component_id string, __times int, shard string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "", ".", ",")) for _ in range(n))


def rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 220)) for _ in range(24)]
    passage = prose(rng, 60)
    texts = [*base, base[0], base[0], base[1] + " end", f"{prose(rng, 20)} {passage}\n{prose(rng, 20)}", f"{passage} {prose(rng, 9)}", "", None, " \t\n", "x" * 300, "x" * 280 + "y", "é" * 90, base[2] + "\n" + base[2]]
    lines = [prose(rng, 6) for _ in range(8)]
    texts += ["\n".join(lines), "\n".join([*lines[2:7], "own line", *lines[:3]]), "\n".join(["a"] * 7), prose(rng, 9000)]
    out = [(i * 3 + 5, t, rng.choice(("en", "fr", None)), rng.choice(("a", "b", "é", None)), len(t or ""), 1, "c", 2, "s") for i, t in enumerate(texts)]
    out.append((None, base[3], None, None, None, 1, "c", 2, "s"))
    out.append(out[4])  # a row that repeats
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def no_id(x):
    return 2**63 - 1 if x is None else x


# --- 1 ---


def brute_fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    got = sorted((no_id(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect())
    ids, fps = zip(*sorted((no_id(r[0]), brute_fingerprint(r[1])) for r in rows()), strict=True)
    root = list(range(len(ids)))
    for _ in ids:
        for a in range(len(ids)):
            for b in range(len(ids)):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = min(root[a], root[b])
    assert got == sorted((i, f"{f:016x}", ids[root[k]]) for k, (i, f) in enumerate(zip(ids, fps, strict=True)))


def test_simhash_chain_of_near_fingerprints(spark):
    """A chain whose ends are far apart, a ball of many close ones, and single ones."""
    rng = random.Random(5)
    at, fps = rng.getrandbits(64), []
    for _ in range(40):
        fps.append(at)
        for p in rng.sample(range(64), 4):
            at ^= 1 << p
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    fps += [rng.getrandbits(64) for _ in range(200)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from ledgerloom.llm.common import Scratch
    from ledgerloom.llm.components import components

    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, len(fps)), Scratch(spark)).collect()}
    root = dict(zip(signed, signed, strict=True))
    while True:
        before = dict(root)
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    root[signed[i]] = min(root[signed[i]], root[signed[j]])
        if before == root:
            break
    assert {k: found.get(k, k) for k in root} == root


def test_components_of_hubs(spark, monkeypatch):
    """Stars, chains and pairs, with every node of a few links a hub, and with none."""
    from ledgerloom.llm import common
    from ledgerloom.llm import components as c
    from ledgerloom.llm.common import Scratch

    rng = random.Random(2)
    ids = rng.sample(range(-1000, 1000), 400)
    links = [(ids[0], x) for x in ids[1:120]] + [(ids[i], ids[i + 1]) for i in range(150, 158)] + [(ids[200 + 2 * i], ids[201 + 2 * i]) for i in range(60)] + [(max(ids), x) for x in ids[330:390]] + [(ids[5], ids[5])]
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(links, "a long, b long")
    for often in (1024, 1):
        monkeypatch.setattr(common, "OFTEN", often)
        assert {r.node: r.root for r in c.components(df, Scratch(spark)).collect()} == root


def test_keep_first_similar(spark):
    """Against brute-force Jaccard: copies with changed words, which lie more than four bits apart, chains, one large group, rows without an id."""
    rng = random.Random(12)
    texts = []
    for _ in range(40):
        words = prose(rng, rng.randint(60, 300)).split()
        texts.append(" ".join(words))
        for _ in range(rng.choice((1, 1, 2, 5))):
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"own{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    passage = prose(rng, 80)  # that many otherwise different texts share, some of them nearly nothing else
    texts += [f"{prose(rng, rng.randint(1, 60))} {passage}" for _ in range(40)]
    base = prose(rng, 150).split()
    texts += [" ".join(w if rng.random() > 0.015 else f"x{rng.randrange(10**6)}" for w in base) for _ in range(60)]
    texts += [texts[0].upper(), "two words", "Two  words", "", None, " \n"]
    table = [(i, t, 0) for i, t in enumerate(texts)]
    rng.shuffle(table)
    table += [(None, texts[1], 0), (None, "alone " * 9, 0), (None, "alone " * 9, 1), (0, texts[0], 5), (0, "another text of the first id", 5)]
    kept = jaccard.keep_first_similar(spark.createDataFrame(table, "doc_id long, text string, __gone_ int").repartition(5))
    assert kept.columns == ["doc_id", "text", "__gone_"]
    kept = kept.collect()
    assert [r.text for r in kept if r.doc_id is None] == ["alone " * 9] and sorted(r.text for r in kept if r.doc_id == 0) == sorted([texts[0], "another text of the first id"])
    got = sorted({r.doc_id for r in kept if r.doc_id is not None})
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    near = [(a, b) for b in range(len(texts)) for a in range(b) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    bits = {(a, b) for b in range(len(texts)) for a in range(b) if (brute_fingerprint(texts[a]) ^ brute_fingerprint(texts[b])).bit_count() <= 4}
    assert len(set(near) - bits) > 20
    root = list(range(len(texts)))
    for _ in range(20):
        for a, b in [*near, *bits]:
            root[a] = root[b] = min(root[a], root[b])
    assert got == [i for i in range(len(texts)) if root[i] == i]


# --- 2 ---


@pytest.mark.parametrize("length", [50, 24])
def test_suffix_dedup(docs, length):
    got = sorted((no_id(r.doc_id), r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, length, part_bytes=700).collect())
    texts = sorted((no_id(r[0]), (r[1] or "").encode()) for r in rows())
    first: dict[bytes, int] = {}
    for i, t in texts:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    want = []
    for i, t in texts:
        mask = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                mask[p : p + length] = b"\1" * length
        want.append((i, len(t), [m.span() for m in re.finditer(b"\1+", bytes(mask))], bytes(c for c, m in zip(t, mask, strict=True) if not m)))
    assert got == sorted(want)


def test_windows_depend_on_the_document_alone(monkeypatch):
    """Wherever blocks begin and in whatever order the rows of a part come."""
    rng = random.Random(7)
    texts = [prose(rng, n).encode() for n in (40, 3, 90, 0, 200)] + [b"z" * 9000, b"", b"ab" * 300]

    def found(texts):
        key, doc, start, count = suffix_dedup.windows(texts)
        return sorted((texts[d], k, s, c) for k, d, s, c in zip(key.tolist(), doc.tolist(), start.tolist(), count.tolist(), strict=True))

    want = sorted(w for t in texts for w in found([t]))
    assert found(texts) == want
    for block in (64, 97, 1000):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        for _ in range(4):
            rng.shuffle(texts)
            assert found(texts) == want


def test_suffix_sort_is_sorted():
    import numpy as np

    rng = random.Random(1)
    for _ in range(60):
        alphabet = rng.choice([b"ab", b"abc", b"a", bytes(range(256))])
        data = np.array([rng.choice(alphabet) for _ in range(rng.randint(1, 300))], np.uint8)
        wanted = np.array([rng.random() < 0.5 for _ in data])
        wanted[0] = True
        words = suffix_dedup.big_endian(data)
        array = suffix_dedup.suffix_sort(data, words, wanted, 50).tolist()
        padded = data.tobytes() + b"\0" * 50
        heads = [padded[i : i + 50] for i in array]
        assert sorted(array) == np.flatnonzero(wanted).tolist() and heads == sorted(heads)
        common = suffix_dedup.common_prefixes(words, np.array(array), 50).tolist()
        assert common[1:] == [next((k for k in range(50) if a[k] != b[k]), 50) for a, b in zip(heads, heads[1:], strict=False)]


# --- 3 ---


def test_line_dedup(docs):
    got = sorted((no_id(r.doc_id), r.n_lines, list(r.removed), r.text or "") for r in line_dedup.remove_repeated_lines(docs).collect())
    seen, want = set(), []
    for i, t in sorted({(no_id(r[0]), r[1]) for r in rows()}, key=lambda x: (x[0], x[1] or "")):
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(max(1, len(lines) - 2) if t else 0):
            w = tuple(lines[p : p + 3])
            gone |= set(range(p, p + len(w))) if w in seen else set()
            seen.add(w)
        want += [(i, len(lines), sorted(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))] * sum(1 for r in rows() if (no_id(r[0]), r[1]) == (i, t))
    assert got == sorted(want)


def test_line_dedup_of_short_texts(spark):
    """A text of one or two lines goes if an earlier text is the same as a whole, not if an earlier one only holds its lines."""
    texts = ["a\nb\nc", "a\nb", "a", "a\nb", "a", "", "", None, None, "b\nc", "a\nb\n", "x " * 200_000, "x " * 200_000, "a\n"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, removed int")
    got = {r.doc_id: list(r.removed) for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert {i: x for i, x in got.items() if x} == {3: [0, 1], 4: [0], 12: [0]} and len(got) == len(texts)


# --- 4 ---


def article(rng: random.Random) -> list[tuple[str, str]]:
    return [("h1", prose(rng, 6)), *(("p", prose(rng, rng.randint(8, 60)).capitalize() + ".") for _ in range(rng.randint(2, 6)))]


def site(rng: random.Random) -> str:
    body = "".join(f"<{t}>{x}</{t}>" for t, x in article(rng))
    return f'<html><head><title>t</title></head><body><nav><ul><li><a href="/">{prose(rng, 1)}</a></li></ul></nav><div class="ad">{prose(rng, 8)}</div><article>{body}</article><footer>&copy; {prose(rng, 6)}</footer></body></html>'


def test_html_blocks():
    page = """<!DOCTYPE html><title>no</title><body><p>a &amp; b<b>c</b><br>d <!-- x --><p>e<ul><li>f<li>g <a href=x>h</a></ul><script>"</p>"</script><div hidden>i<div>j</div></div>k<table><tr><td>l<td>m</table><p>n"""
    assert [b.text for b in html_extract.leaf_blocks(page)] == ["a & bc d", "e", "f", "g h", "k", "l", "m", "n"]
    assert [b.text for b in html_extract.leaf_blocks("plain")] == ["plain"]
    assert html_extract.leaf_blocks("") == html_extract.leaf_blocks("<p") == html_extract.leaf_blocks("<!-- open") == []


def test_html_hidden():
    texts = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    for attribute in ('class="overflow-hidden"', 'aria-hidden="false"', 'title="The hidden valley"', 'id="hidden-gems"', 'href="/hidden-lake"', "data-hidden", 'title="display: none"', 'title=" hidden "', 'style="display: block"'):
        assert texts(f"<article {attribute}><p>a <a {attribute}>b</a></p></article>c") == ["a b", "c"]
    for attribute in ("hidden", 'hidden=""', "class=x HIDDEN", 'aria-hidden="true"', "aria-hidden=true", 'style="color: red; display:none"', "style='DISPLAY : NONE'"):
        assert texts(f"<p>a<span {attribute}>b<br>c</span>d</p><div {attribute}><p>e<div>f</div></div>g") == ["ad", "g"]
        assert texts(f"<p {attribute}>a<p>b<ul>c<li {attribute}>d<li>e</ul><div>f<p {attribute}>g</div>h<p>i") == ["b", "c", "e", "f", "h", "i"]
        assert texts(f"<div>a<div {attribute}>b</div>c</div><a {attribute}><div>d</div>e</a>f<section {attribute}>g<script>'</section>'</script>") == ["ac", "f"]
    path = html_extract.leaf_blocks("<main>a<div hidden>b")[0].path
    assert path == (("main", ()),)


def test_html_extraction_held_out(spark):
    """Blocks of pages in layouts that the field wasn't trained on one by one: nearly all labels are right."""
    rng = random.Random(2)
    field = html_extract.train(html_extract.training_set([site(rng) for _ in range(60)]))
    right = total = 0
    for rows_, labels in html_extract.training_set([site(rng) for _ in range(40)], seed=77):
        right += sum(a == b for a, b in zip(field.labels(rows_), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97
    pages = spark.createDataFrame([(1, "u", site(rng), 0), (2, None, None, 0), (3, "v", "", 0), (None, "w", "<p>", 0), (3, "v", "", 0)], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url): r for r in html_extract.extract(pages, field).collect()}
    blocks = html_extract.leaf_blocks(pages.where("page_id = 1").first().html)
    assert got[1, "u"].text == "\n".join(b.text for b in blocks if ("article", ()) in b.path) and got[1, "u"].n_chars == len(got[1, "u"].text)
    assert got[2, None].text == got[3, "v"].text == got[None, "w"].text == ""
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_of_broken_markup():
    texts = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    assert texts('<p>see <a title="x>more</a> here<p>next') == ["see more here", "next"]
    assert texts("<div class='a>b</div><p>c") == ["b", "c"] and texts('<a title="a > b">c</a>') == ["c"]
    assert texts("<p>if <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> then <svg><title>no</title><text>yes</text></svg> <object>it</object>") == ["if x<2 then yes it"]


def test_html_of_short_and_bare_pages():
    """Pages of a block or two, without wrappers or names, and what looks like something else at first sight."""
    first = "The old bridge over the river was closed for repairs on Monday, and drivers were told to take the longer road through the valley."
    second = "Officials said that the work would last about three weeks if the weather stays dry, but they gave no firm date for the reopening."
    law = "Copyright law was changed by parliament on Tuesday, which surprised many of the publishers."
    chinese = "这座古老的桥梁横跨河流，周一因维修而关闭，司机们被告知要绕行穿过山谷的较长道路。官员们表示，如果天气保持干燥，工程将持续约三周。"
    menu, foot = "<ul class='menu'><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul>", "<div class='footer'>© 2020 All rights reserved</div>"
    pages = [
        (f"<p>{first}</p><p>{second}</p>", [first, second]),
        (f"<html><body>{menu}<div>{first}</div><div>{second}</div>{foot}</body></html>", [first, second]),
        (f"{first} {second}", [f"{first} {second}"]),
        (f"<html><body><p>{chinese}</p></body></html>", [chinese]),
        ("<article><p>Tom &amp; Ann say caf&eacute; prices rose by 5 &lt; 6 percent.</p></article>", ["Tom & Ann say café prices rose by 5 < 6 percent."]),
        (f"<html><body><article><p>{law}</p><p>{second}</p></article></body></html>", [law, second]),
        (f"<html><body><nav><a href='/'>Home</a></nav><div class='post'><p>{first}</p></div></body></html>", [first]),
    ]
    rng = random.Random(3)
    for field in (html_extract.train(html_extract.invented_set()), html_extract.train(html_extract.invented_set() + html_extract.training_set([site(rng) for _ in range(200)]))):
        for page, want in pages:
            assert html_extract.main_text(page, field).split("\n") == want


def test_html_labelled_by_hand(spark):
    """Blocks of unlike layouts that no generator made, by the field that knows no table, and by one that a table of one layout has adapted."""
    from labelled_pages import PAGES

    rng = random.Random(3)
    alike = [site(rng) for _ in range(40)]
    fields = [html_extract.train(html_extract.invented_set()), html_extract.train(html_extract.invented_set() + html_extract.training_set(alike))]
    for field in fields:
        right = found = wanted = 0
        for page, text in PAGES:
            got, want = html_extract.main_text(page, field).split("\n"), text.split("\n")
            right += len(set(got) & set(want))
            found, wanted = found + len(got), wanted + len(want)
        assert 2 * right / (found + wanted) >= 0.95
    pages = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(PAGES) if "<article" not in p and "<main" not in p], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}  # a table that names no article
    assert sum(got[i] == PAGES[i][1] for i in got) >= len(got) - 1 and all(got.values())


def test_field_marginals():
    """The sum over all paths and the probabilities, against all paths one by one."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    s, step, begin = rng.normal(size=(4, 5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [5, 3, 1, 4]
    real = np.arange(5)[None, :] < np.array(sizes)[:, None]
    z, p, joint = html_extract.marginals(s, real, step, begin)
    for page, n in enumerate(sizes):
        score = lambda y: begin[y[0]] + sum(s[page, i, k] for i, k in enumerate(y)) + sum(step[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        paths = {y: np.exp(score(y)) for y in itertools.product((0, 1), repeat=n)}
        total = sum(paths.values())
        assert z[page] == pytest.approx(np.log(total))
        for i in range(5):
            for k in (0, 1):
                assert p[page, i, k] == pytest.approx(sum(v for y, v in paths.items() if i < n and y[i] == k) / total)
                for m in (0, 1):
                    if i < 4:
                        assert joint[page, i, k, m] == pytest.approx(sum(v for y, v in paths.items() if i + 1 < n and (y[i], y[i + 1]) == (k, m)) / total)


def test_html_training_sample(spark):
    rng = random.Random(4)
    data = [(i, "u", site(rng)) for i in range(12)] + [(50, "u", "<p>no article</p>"), (51, "u", None)]
    pages = spark.createDataFrame(data + data[:3], "page_id long, url string, html string").repartition(4)
    got = html_extract.sample(pages, 5)
    assert len(got) == 5 == len(set(got)) and got == html_extract.sample(pages.repartition(2), 5)
    assert set(html_extract.sample(pages)) == {h for i, _, h in data if i < 12}
    assert html_extract.sample(pages.where("page_id > 49")) == []
    texts = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(texts[i] == "\n".join(b.text for b in html_extract.leaf_blocks(h) if ("article", ()) in b.path) for i, _, h in data[:12])
    assert {r.page_id: r.text for r in html_extract.extract(pages.where("page_id > 49")).collect()}[51] == ""


def test_viterbi_is_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    field = html_extract.Field(list("abcd"), rng.normal(size=(4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in range(1, 7):
        rows_ = [[x for x in "abcd" if rng.random() < 0.5] for _ in range(n)]
        score = lambda y: field.begin[y[0]] + sum(field.emit[field.number[f], k] for r, k in zip(rows_, y, strict=True) for f in r) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert score([int(x) for x in field.labels(rows_)]) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=n))))


# --- 5 ---


def direct_ends(text: bytes, radius: int) -> list[int]:
    """Chunk ends by the definition: the hash of each place from its 32 bytes, the least within radius on both sides, then the next character."""
    n, ends = len(text), []
    gear, x = [], 0
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        z = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        gear.append((z ^ z >> 31) % 2**32)
    hashes = [sum(gear[text[i - k]] << k for k in range(min(32, i + 1))) % 2**32 for i in range(n)]
    last = -(10**9)
    for i in range(radius, n - radius):
        if hashes[i] == min(hashes[i - radius : i + radius + 1]):
            if i - last > radius:
                ends.append(i + 1)
            last = i
    ends = [next(j for j in range(e, n + 1) if j == n or text[j] & 0xC0 != 0x80) for e in ends]
    return sorted({*ends, n} - {0})


def direct_chunks(text: bytes, radius: int) -> list[tuple[int, int]]:
    out, begin = [], 0
    for end in direct_ends(text, radius) if text else []:
        while end - begin > chunk_dedup.LONGEST:
            cut = begin + chunk_dedup.LONGEST
            while cut < end and text[cut] & 0xC0 == 0x80:
                cut += 1
            out.append((begin, cut))
            begin = cut
        if begin < end:
            out.append((begin, end))
        begin = end
    return out


def test_chunk_dedup(spark):
    """Against a direct gear hash; short copies of whole texts go as well."""
    table = [(r[0], r[1]) for r in rows()] + [(700 + i, t) for i, t in enumerate(("That it.", "That it.", "That it. And more", "", "x" * 50, "x" * 50, "é" * 5000))]
    got = sorted((no_id(r.doc_id), r.n_bytes, r.n_chunks, [(s.begin, s.end) for s in r.spans], r.text) for r in chunk_dedup.remove_repeated_chunks(spark.createDataFrame(table, "doc_id long, text string").repartition(5), part_bytes=7000).collect())
    first: dict[bytes, tuple[int, int]] = {}
    texts = sorted((no_id(i), (t or "").encode()) for i, t in table)
    cuts = {t: direct_chunks(t, chunk_dedup.RADIUS) for _, t in texts}
    for i, t in texts:
        for a, b in cuts[t]:
            first.setdefault(t[a:b], (i, a))
    want = []
    for i, t in texts:
        mask = bytearray(len(t))
        for a, b in cuts[t]:
            if first[t[a:b]] != (i, a):
                mask[a:b] = b"\1" * (b - a)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(mask))]
        want.append((i, len(t), len(cuts[t]), spans, bytes(c for p, c in enumerate(t) if not mask[p]).decode()))
    assert got == sorted(want)
    assert {x[0]: x[4] for x in got}[701] == "" and any(spans for *_, spans, _ in want)


def test_chunks_follow_the_text():
    rng = random.Random(4)
    text = prose(rng, 4000).encode()
    ends = chunk_dedup.chunk_ends(text)
    assert ends[-1] == len(text) and min(b - a for a, b in zip(ends, ends[1:], strict=False)) > 0
    moved = chunk_dedup.chunk_ends(b"some words before " + text)
    shared = {e + 18 for e in ends} & set(moved)
    assert len(shared) >= len(ends) - 2
    same = [0, *chunk_dedup.chunk_ends(b"z" * 20_000)]
    assert max(b - a for a, b in zip(same, same[1:], strict=False)) <= chunk_dedup.LONGEST
    whole = chunk_dedup.chunk_ends(text * 60)
    assert whole == sorted(set(whole)) and whole[-1] == 60 * len(text)


# --- 6 ---


def test_mixing(docs):
    mix = mixing.mixture(docs)
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows())
    sizes: dict[str, list[int]] = {}
    for r in rows():
        sizes.setdefault("n" if r[3] is None else "a" + r[3], []).append(len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")))
    per = {r.src: r for r in mix.sources.collect()}
    assert {k: v.source_size for k, v in per.items()} == {k: sum(v) for k, v in sizes.items()}
    weights = dict(zip(sorted(sizes), (3, 1, 2) * 9, strict=False))
    target, free, left = {}, set(sizes), 1.5 * sum(map(sum, sizes.values()))
    while over := [s for s in free if left * weights[s] / sum(weights[x] for x in free) > 2 * sum(sizes[s])]:
        for s in over:
            target[s] = 2.0 * sum(sizes[s])
        free -= set(over)
        left = 1.5 * sum(map(sum, sizes.values())) - sum(target.values())
    target |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
    assert {k: v.target for k, v in per.items()} == pytest.approx(target)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for s, v in per.items():
        assert sum(r.taken for r in got if r.source_size == v.source_size) == int(v.target) or len({x.source_size for x in per.values()}) < len(per)
    slots = mix.pieces.select("slot", "src").distinct().orderBy("slot").collect()
    half = slots[: len(slots) // 2]  # every stretch has each source nearly in proportion
    for s, v in per.items():
        assert abs(sum(x.src == s for x in half) - v.slots / 2) <= 8
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs.repartition(3)).collect()), key=str)


def test_mixed_rows(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = out.count()
    assert 0 < n <= 2 * docs.count()


def test_mixed_judges_each_row(spark):
    """Of rows that share an id, or have none, each comes as often as its own words are taken."""
    rng = random.Random(12)
    table = [(rng.choice((1, 2, None)), prose(rng, 400), f"s{i % 2}") for i in range(40)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    mix = mixing.mixture(docs)
    words = mix.pieces.groupBy("src", "start", "size", "epoch").agg(F.sum("words").alias("w")).where("2 * w >= size").groupBy("src", "start").count()
    want = sum(r["count"] for r in words.collect())
    assert mixing.mixed(docs).count() == want


# --- 7 ---


def brute_groups(table: list[tuple]) -> dict[str, list]:
    """Of each text: bytes and the least coordinates of its rows."""
    digest = lambda x: -1.0 if x is None else float(int(hashlib.md5(x.encode()).hexdigest()[:8], 16))
    out: dict[str, list] = {}
    for r in table:
        at = (digest(r[2]), digest(r[3]), -1.0 if r[4] is None else float(r[4]))
        g = out.setdefault(r[1] or "", [0, at])
        g[0] += len((r[1] or "").encode()) + 8
        g[1] = tuple(map(min, g[1], at))
    return out


def brute_tree(table: list[tuple], shards: int) -> dict[str, int]:
    """The shard of each text."""
    groups = [(size, at, hashlib.md5(t.encode()).digest(), t) for t, (size, at) in brute_groups(table).items()]
    spread = [max(1.0, max(g[1][d] for g in groups) - min(g[1][d] for g in groups)) for d in range(3)]
    out: dict[str, int] = {}
    groups.sort(key=lambda g: (-g[0], g[2]))
    left = shards
    while groups and groups[0][0] * left >= sum(g[0] for g in groups):
        left -= 1
        out[groups.pop(0)[3]] = left

    def split(part: list, first: int, m: int) -> None:
        if m == 1 or not part:
            return out.update({g[3]: first for g in part})
        wide = max(range(3), key=lambda d: (max(g[1][d] for g in part) - min(g[1][d] for g in part)) / spread[d])
        part = sorted(part, key=lambda g: (g[1][wide], g[2]))
        total, few = sum(g[0] for g in part), m // 2
        small = [g[0] * m * kdshard.SMALL <= total for g in part]
        before, sides = 0, {}
        for g, s in zip(part, small, strict=True):
            if not s:
                sides[g[3]] = (2 * before + g[0]) * m >= 2 * total * few
            before += g[0]
        below, want = 0, total * few - m * sum(g[0] for g in part if sides.get(g[3]) is False)
        for g, s in zip(part, small, strict=True):
            if s:
                sides[g[3]] = (2 * below + g[0]) * m >= 2 * want
                below += g[0]
        split([g for g in part if not sides[g[3]]], first, few)
        split([g for g in part if sides[g[3]]], first + few, m - few)

    split(groups, 0, left)
    return out


def many_rows() -> list[tuple]:
    """Many small texts beside larger ones, copies with other metadata, and copies that hold a third of all rows."""
    rng = random.Random(21)
    texts = [prose(rng, rng.choice((1, 2, 4, 9, 60, 200))) for _ in range(700)]
    texts += [rng.choice(texts[:200]) for _ in range(100)] + ["one very common text, " * 9] * 400
    return [(rng.randrange(500) if i % 50 else None, t, rng.choice(("en", "fr", None)), rng.choice("abc"), rng.choice((len(t), None)), 1, "c", 2, "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("shards,table", [(24, rows()), (5, rows()), (1, rows()), (24, many_rows()), (7, many_rows())])
def test_sharding(spark, shards, table):
    got = kdshard.tree_shards(spark.createDataFrame(table, SCHEMA).repartition(5), shards).collect()
    assert sorted((no_id(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((no_id(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in table)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    tree = brute_tree(table, shards)
    want = {zlib.crc32(t.encode()): s for t, s in tree.items()}
    assert {(r.text_crc32, r.shard) for r in got} == set(want.items()) and set(by) <= set(range(shards))  # equal texts are in one shard


def test_shards_are_even(spark):
    """Small texts make up for large ones, and a group over the mean leaves the others even."""
    got = kdshard.tree_shards(spark.createDataFrame(many_rows(), SCHEMA), 7)
    sizes = sorted(r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect())
    largest = max(x[0] for x in brute_groups(many_rows()).values())
    assert sizes[-1] == largest and max(sizes[:-1]) <= 1.02 * sum(sizes[:-1]) / 6 and min(sizes) >= 0.98 * sum(sizes[:-1]) / 6


def test_sharded_rows(spark, docs, empty):
    clash = docs.withColumns({"_row": F.lit(1), "_turn": F.lit(2), "mark": F.lit(3), "__id": F.lit(4), "node": F.lit(5), "Slot": F.lit(6), "a.b": F.lit(7)})
    out = kdshard.sharded(clash)
    assert out.columns == [c for c in clash.columns if c.lower() not in ("shard", "slot")] + ["shard", "slot"] and out.count() == docs.count()
    assert out.select("shard", "slot").distinct().count() == docs.count()
    places = lambda df: sorted((no_id(r[0]), *r[1:]) for r in df.collect())
    assert places(out.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "shard", "slot")) == places(kdshard.tree_shards(docs).select("doc_id", "text_crc32", "shard", "slot"))
    assert kdshard.sharded(empty).count() == 0


# --- 8 ---


def test_decontamination(spark, docs, empty):
    items = [(1, "If Tom buys 12 apples and each apple costs 3 dollars then how much money does Tom need in total"), (2, "the long river runs through seven green valleys before it meets the cold sea at last"), (3, "short one here with five"), (4, None), (5, "")]
    texts = [
        (1, "intro words. " + items[0][1] + " and more"),
        (2, "Well, if Anna buys 40 apples and each apple costs 7 dollars then how much money does Anna need in total?"),
        (3, "Then if Anna buys 40 apples and each apple costs 7 dollars then how much money does Beth need in total"),
        (4, items[1][1].upper()),
        (5, "the long river runs far away"),
        (6, None),
        (7, "short one here with five"),
        (7, "short one here with five"),
        (None, items[1][1]),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, __held int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (7, 3), (None, 2)}
    assert not got[1, 1].reparameterised and got[2, 1].reparameterised and got[2, 1].covered == 1.0
    assert got[3, 1].covered < 1.0  # the second name contradicts the first
    kept = decontaminate.decontaminated(d, bench)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6]
    assert decontaminate.contaminated(empty, bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def matches(items: list[tuple[int, bytes]], text: bytes) -> dict[int, tuple]:
    """What each item finds in a text: windows, share, slots, whether a slot is filled otherwise."""
    known = decontaminate.Words()
    doc = decontaminate.Document(text, known)
    got = {i: decontaminate.Item(t, 8, known).match(doc, 0.5) for i, t in items}
    return {i: m for i, m in got.items() if m}


def test_decontamination_of_few_literal_words():
    ran = b"Tom ran 5 km in 20 minutes, Ann ran 6 km in 25 minutes, Bob ran 7 km in 30 minutes."
    cost = b"If 3 kg cost 12 dollars and 5 kg cost 20 dollars, 8 kg cost 32 dollars."
    items = [(1, ran), (2, cost), (3, b"1 2 3 4 5 6 7 8 9 10")]
    found = lambda t: matches(items, t)
    assert found(b"words before. " + ran + b" After.")[1][1] == 1.0 and not found(ran)[1][3]
    assert found(b"so, " + cost)[2][1] == 1.0
    other = b"If 4 lb cost 10 euros and 6 lb cost 15 euros, 9 lb cost 25 euros."
    assert found(b"words before. " + other)[2][1:] == (1.0, 8, True)
    assert not found(other.replace(b"9 lb", b"9 oz"))  # one unit stands for two
    assert not found(b"3 4 5 6 7 8 9 11 12 13") and set(found(b"0 1 2 3 4 5 6 7 8 9 10")) == {3}
    # windows of few literal words behind one that tells
    long = b"the farmer then carries every full basket and sells 5 kg for 20 dollars, 6 kg for 25 dollars, 7 kg for 30 dollars, 8 kg for 35 dollars"
    assert matches([(1, long)], long.replace(b"25", b"99").replace(b"35", b"88"))[1][1] == 1.0


def test_decontamination_judges_each_occurrence():
    """A worksheet holds the item word for word and with other values, so that no one value is elected for both slots."""
    item = "If Tom buys 12 apples and each apple costs 3 dollars then how much money does Tom need in total"
    items = [(1, item.encode())]
    copies = [item.replace("12", a).replace("3 d", f"{b} d").replace("Tom", c) for a, b, c in (("12", "3", "Tom"), ("40", "7", "Anna"), ("55", "8", "Beth"))]
    for seed in range(20):
        texts = copies[:2] + copies[2:] * (seed % 2)
        random.Random(seed).shuffle(texts)
        # pieces that sway the votes: of one copy the first half, of another the second
        pieces = [" ".join(copies[1].split()[:10]), " ".join(copies[2].split()[-14:])] * (1 + seed % 3)
        found = matches(items, "\n\n".join(texts + pieces).encode())
        assert [(i, m[1], m[3]) for i, m in found.items()] == [(1, 1.0, False)]
    two = f"{copies[1]}. {' '.join(copies[2].split()[:10])} {copies[2]}. {' '.join(copies[1].split()[-14:])}"
    assert matches(items, two.encode())[1][1] == 1.0


def brute_template(text: str) -> list[tuple[str, str]]:
    """Kind and literal form of each word, one word after another."""
    out = []
    for line in text.split("\n"):
        starts = True
        for w in line.split():
            core = w.strip(".,;:!?\"'()[]{}<>*_#`~|")
            ends = w.endswith((".", "!", "?", ".\"", "!\"", "?\"", ".'", ".)", ":"))
            if not core:
                starts = starts or ends
                continue
            kind = "word"
            if re.match(r"^[+\-$]*\d[\d.,:/]*(%|st|nd|rd|th)?$", core):
                kind = "number"
            elif core.lower() in decontaminate.UNITS:
                kind = "unit" if out and out[-1][0] == "number" else "word"
            elif len(core) > 1 and core[0].isupper() and not core[1:].isupper() and not starts:
                kind = "name"
            out.append((kind, core.lower()))
            starts = ends
    return out


def brute_verbatim(item: str, text: str) -> bool:
    a, b = ([w for _, w in brute_template(x)] for x in (item, text))
    return any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))


def brute_filled(item: str, text: str) -> bool:
    """Whether the text has the item's whole template somewhere with each value standing for one value."""
    a, b = brute_template(item), brute_template(text)
    for i in range(len(b) - len(a) + 1):
        part, stands = b[i : i + len(a)], {}
        if all(k == k2 and (k == "word" and w == w2 or k != "word" and stands.setdefault((k, w), w2) == w2) for (k, w), (k2, w2) in zip(a, part, strict=True)):
            return True
    return False


def test_decontamination_of_random_items(spark):
    """Items copied word for word are found however few literal words they have, refilled ones if four are literal, and others aren't."""
    rng = random.Random(31)
    names, units = ["Tom", "Ann", "Beth", "Paul"], ["km", "kg", "dollars", "minutes"]

    def item(literals: float) -> str:
        words = []
        for _ in range(rng.randint(3, 26)):
            words += [rng.choice(WORDS)] if rng.random() < literals else rng.choice(([str(rng.randint(1, 99))], [str(rng.randint(1, 99)), rng.choice(units)], [rng.choice(names)]))
        return "Then " + " ".join(words) + rng.choice(".?")

    def refilled(text: str) -> str:
        new = {w: rng.choice([x for x in pool]) for pool in (["Kurt", "Lisa", "Olga"], ["lb", "miles", "euros"]) for w in (names if "Kurt" in pool else units)}
        return " ".join(new.get(w.strip(".?"), w) if not w.strip(".?").isdigit() else str(int(w.strip(".?")) + 100) for w in text.split())

    items = [item(rng.choice((0.2, 0.5, 0.9))) for _ in range(60)] + ["What is 12 times 30?", "Is 17 prime?", "Who was Pope Leo X?"]
    texts = [f"{prose(rng, rng.randint(0, 40))}\n{rng.choice((t, t, refilled(t)))} {prose(rng, rng.randint(0, 40))}" for t in items] + [prose(rng, 60) for _ in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    for d, text in enumerate(texts):
        for i, t in enumerate(items):
            words = brute_template(t)
            if brute_verbatim(t, text):
                assert got[d, i].covered == 1.0
            elif brute_filled(t, text) and sum(k == "word" for k, _ in words) >= 4:
                assert got[d, i].covered == 1.0 and got[d, i].reparameterised
            elif d != i:
                assert (d, i) not in got
    assert sum(d == i for d, i in got) > 50


def test_decontamination_of_common_openings(spark, monkeypatch):
    """Items and documents that share an opening make no pairs by it; keys lose no match, whatever windows are common."""
    rng = random.Random(17)
    opening = "which of the following statements about the given passage is most likely to be"
    items = [(i, f"{opening} {prose(rng, 20)}".lower()) for i in range(40)] + [(100 + i, f"{opening} {prose(rng, 3)}".lower()) for i in range(5)]
    texts = [(i, f"{prose(rng, 10)} {opening} {prose(rng, 10)}") for i in range(40)] + [(100 + i, f"{prose(rng, 5)} {t} {prose(rng, 5)}") for i, t in items[::3]]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    want = {(d, i): m for d, t in texts for i, m in matches([(i, x.encode()) for i, x in items], t.encode()).items()}
    for together in (32, 1):
        monkeypatch.setattr(decontaminate, "TOGETHER", together)
        got = {(r.doc_id, r.item_id): (r.n_windows, r.covered, r.n_slots, r.reparameterised) for r in decontaminate.contaminated(docs, bench).collect()}
        assert got == want and len(want) > 15
    known = decontaminate.Words()
    for _, text in items[:40]:
        item = decontaminate.Item(text.encode(), 8, known)
        often = {h: 1 for _, hashes, _ in item.entries() for h in hashes.view("int64").tolist()}
        shared = decontaminate.Item(opening.encode(), 8, known)
        common = {h for _, hashes, _ in shared.entries() for h in hashes.view("int64").tolist()}
        assert common and not common & set(item.keys({h: 1000 if h in common else n for h, n in often.items()}, 0.5))


def test_decontamination_by_joins_alone(spark, monkeypatch):
    """A benchmark too large to broadcast, and a bitmap that is nearly full, change nothing."""
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(4, 40))) for i in range(80)]
    docs = [(i if i % 7 else None, f"{prose(rng, 30)} {items[i % 90][1]} {prose(rng, 5)}" if i % 90 < 80 and i % 2 else prose(rng, 50)) for i in range(120)] + [(5, ""), (6, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (None, None), (3, "")], "item_id long, text string")
    want = sorted(map(str, decontaminate.contaminated(d, b).collect()))
    kept = sorted(map(str, decontaminate.decontaminated(d, b).collect()))
    assert len(want) > 40 and sum("None" in x for x in kept) > 5  # rows without an id are judged one by one
    for name, value in (("FEW_ROWS", 0), ("FEW_BYTES", 0), ("MOST_BITS", 1 << 13), ("BATCH", 64)):
        monkeypatch.setattr(decontaminate, name, value)
    assert sorted(map(str, decontaminate.contaminated(d, b).collect())) == want
    assert sorted(map(str, decontaminate.decontaminated(d, b).collect())) == kept


# --- 9 ---


def brute_quality(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = len(words)

    def longest(i: int) -> int:
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        return best

    reach = [longest(i) for i in range(n)] if n < 600 else None
    grams: dict[tuple, int] = {}
    for i in range(n - 2):
        g = tuple(words[i : i + 3])
        grams[g] = grams.get(g, 0) + 1
    repeated = {p for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    base = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))
    if reach is None:
        return base
    covered = {p for i in range(n) if reach[i] >= 10 for p in range(i, i + reach[i])}
    return (*base, len(covered), max(reach, default=0))


def test_quality_rules(docs, empty):
    got = sorted(tuple(r)[1:8] for r in repetition.quality(docs).collect())
    want = sorted(brute_quality(r[1]) for r in rows())
    for g, w in zip(got, want, strict=True):
        assert g[: len(w)] == w
    for r in repetition.quality(docs).collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.n_covered <= 0.3 * r.n_words and r.longest <= repetition.MAX_LONGEST)
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    good = [r for r in rows() if (m := brute_quality(r[1]))[0] >= 600 or repetition.passes(m, 0.3, 100)]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, good))  # each row by its own text
    assert repetition.keep_good(empty).count() == 0
    assert repetition.quality(empty).count() == 0


def test_repeats_of_random_words():
    rng = random.Random(8)
    for _ in range(40):
        texts = [" ".join(rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(0, 60))).encode() for _ in range(4)]
        assert repetition.measure(texts) == [brute_quality(t.decode()) for t in texts]


# --- 10 ---


def test_classifier_held_out(spark):
    rng = random.Random(6)
    data = []
    for i in range(900):
        t, g = prose(rng, rng.randint(30, 200)), rng.choice((0, 1, 2, 2, 2))
        if g == 0:
            t += " " + rng.choice(("vile1", "vile2", "vile3"))
        if g == 1:
            t = " ".join(w + "%%" for w in t.split())
        data.append((i, t, g))
    d = spark.createDataFrame([(i, t) for i, t, _ in data] + [(9999, None), (9998, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g > 1), int(g == 0), "x") for i, _, g in data if i % 2] + [(None, 1, 0, "x"), (1, 1, None, "x")], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in ordinal.classify(d, labels).collect()}
    assert len(got) == len(data) + 3
    held = [(got[i].selected, g) for i, _, g in data if not i % 2]
    assert sum(s == (g == 2) for s, g in held) / len(held) > 0.95
    assert all(0 <= r.tail_probability <= r.expected_grade <= 2 for r in got.values())
    none = ordinal.classify(d, labels.limit(0)).collect()
    assert len(none) == len(got)


def test_classifier_gradient_and_tail():
    """Slopes against differences of the loss as its definition gives it, and the fit against that loss."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows_ = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(300)]
    grades = np.array([min(2, int((1 in r) + (2 in r) + (rng.random() < 0.2))) for r in rows_])
    weight = 300 / (3 * np.bincount(grades))[grades]

    def loss(scores, t):
        above = [[1.0, *(1 / (1 + np.exp(x - s)) for x in t), 0.0] for s in scores]
        return -sum(w * np.log(a[g] - a[g + 1]) for w, a, g in zip(weight, above, grades, strict=True))

    scores, t = rng.normal(size=300), np.array([-0.7, 0.4])
    by_score, by_t = ordinal.slopes(scores, t, grades, weight)
    for i in range(0, 300, 29):
        step = 1e-5 * (np.arange(300) == i)
        assert by_score[i] == pytest.approx((loss(scores + step, t) - loss(scores - step, t)) / 2e-5, rel=1e-3)
    for k in range(2):
        step = 1e-5 * (np.arange(2) == k)
        assert by_t[k] == pytest.approx((loss(scores, t + step) - loss(scores, t - step)) / 2e-5, rel=1e-3)
    weights, t = ordinal.fit(rows_, grades, 3)
    fitted = np.array([ordinal.score(r, weights) for r in rows_])
    assert loss(fitted, t) < 0.7 * loss(np.zeros(300), np.array([-1.0, 1.0])) and t[0] < t[1]
    assert ordinal.best_tail(rows_, grades, 3) in ordinal.TAILS and ordinal.best_tail([], grades[:0], 3) == ordinal.TAILS[0]


def test_classifier_labels_that_disagree(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 1), (2, 1, 0), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, ordinal.sample(d, labels).select("doc_id", F.col("text").cast("string"), "grade").collect())) == [(1, "a", 0), (2, "b", 2), (2, "c", 2)]


# --- all of them on empty tables ---


def test_empty_tables(empty, docs):
    assert simhash.simhash_components(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert line_dedup.remove_repeated_lines(empty).count() == 0
    assert chunk_dedup.remove_repeated_chunks(empty).count() == 0
    assert mixing.taken(empty).count() == 0
    assert kdshard.tree_shards(empty).count() == 0
    assert ordinal.classify(empty, empty.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))).count() == 0


def test_pipeline(spark, tmp_path):
    """Stage by stage, each against brute force on what the stage before kept."""
    import corpus_pipeline

    rng = random.Random(9)
    item = "the long river runs through seven green valleys before it meets the cold sea"
    far = [prose(rng, rng.randint(60, 200)) for _ in range(30)]
    texts = [*far, *far[:4], far[5] + " more.", f"{prose(rng, 40)}\n{item} {prose(rng, 30)}", " ".join(far[6].split()[:20] * 6), prose(rng, 10), None, ""]
    table = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        after.append(now)
    assert all(d.columns == docs.columns for d in after[:-1])
    ids = [sorted(r.doc_id for r in d.collect()) for d in after]

    def good(text):
        n, _, _, _, repeated, covered, longest = brute_quality(text)
        return n >= 50 and 100 * repeated <= 50 * n and covered <= 0.3 * n and longest <= repetition.MAX_LONGEST

    assert ids[0] == [i for i, t in enumerate(texts) if good(t)]
    fps = {i: brute_fingerprint(texts[i]) for i in ids[0]}
    root = {i: i for i in ids[0]}
    for _ in ids[0]:
        root = {i: min(root[j] for j in ids[0] if (fps[i] ^ fps[j]).bit_count() <= 4) for i in ids[0]}
    assert ids[1] == [i for i in ids[0] if root[i] == i] and len(ids[1]) < len(ids[0])
    assert ids[2] == [i for i in ids[1] if item not in texts[i]] and len(ids[2]) < len(ids[1])
    taken = {r.doc_id: r for r in mixing.taken(after[2]).collect()}
    times = {i: ids[3].count(i) for i in ids[2]}
    assert set(ids[3]) <= set(ids[2]) and all(abs(times[i] - taken[i].taken / taken[i].size) <= 1 for i in ids[2])
    assert ids[4] == ids[3] and after[4].columns == [*docs.columns, "shard", "slot"]
    places = [(r.shard, r.slot) for r in after[4].collect()]
    assert len(set(places)) == len(places) and {s for s, _ in places} <= set(range(24))
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, after[4].collect()))


def test_mixed_keeps_clashing_columns(spark):
    rows = [(i, f"word{i} " * 40, "web", i, -i, 2 * i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __mixed_turn int, _turn int, _id int")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r["__mixed_turn"] == r["doc_id"] and r["_turn"] == -r["doc_id"] and r["_id"] == 2 * r["doc_id"] for r in got)
