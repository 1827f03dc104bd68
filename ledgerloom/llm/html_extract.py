"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into leaf blocks, runs of text between the borders of block elements, each with its ancestors.
Features of a block are its ancestors' tags and class or id words and what its text looks like; the
field scores each block's label (main text or not) and each pair of neighbouring labels, and
Viterbi picks the labels. It is trained on labelled pages: on pages of invented prose in many layouts, which don't depend
on the table; and, where pages of the table name their article, on a bounded sample of these and on copies of
them laid out in other ways with the same labels, so that it learns many names for the same part and not one site's habits.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the field is trained on, at most, and copies of each in other layouts.
MAX_TRAIN, COPIES = 200, 2
#: Pages of invented prose.
INVENTED = 500
#: The share of invented layouts whose article has no named wrapper.
PLAIN = 0.25
#: Blocks of fewer words are short: what they say and whether they stand first or last tells more.
PROSE = 12
ROUNDS, RATE, L2 = 120, 0.2, 1e-3
LEAST_COUNT = 3

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ANY_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MAY_HIDE = re.compile(r"hidden|display", re.I)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
ENDS = '.!?…»”"。！？'
#: Characters of scripts that put no spaces between words; two count as a word.
UNSPACED = re.compile(r"[\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

#: Elements by how HTML treats them.
RAW = frozenset("script style noscript template iframe textarea select title desc head canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html button option td th tr tbody thead tfoot caption legend summary".split())
SCOPES = frozenset("table td th article section div nav aside footer header main form body html".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tbody thead tfoot tr td th", "thead": "tbody", "tfoot": "tbody tr td th"}


class Block(NamedTuple):
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # ancestors from outside in: tag, words of class, id, role
    linked: int  # characters inside links


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Markup that is cut off or not closed is read as browsers do, nearly; hidden elements give none
    and end as others do, with their end tag, their parent or what else closes them."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, links, at, n = 0, 0, 0, len(page)
    dark: int | None = None  # where in the stack a hidden element is, whose content gives no text

    def text(raw: str) -> None:
        nonlocal linked
        if raw and dark is None:
            raw = html.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if links:
                linked += len(raw.strip())

    def close() -> None:
        nonlocal linked
        if dark is not None:
            return
        if pieces:
            if whole := SPACE.sub(" ", "".join(pieces)).strip():
                out.append(Block(whole, tuple(stack), linked))
            pieces.clear()
        linked = 0

    def pop(upto: int) -> None:
        if dark is None or upto < dark:  # text goes on behind a hidden element
            if dark is not None:
                cut(dark)
            close()
        cut(upto)

    def cut(upto: int) -> None:
        nonlocal links, dark
        links -= sum(t == "a" for t, _ in stack[upto:])
        del stack[upto:]
        if dark is not None and len(stack) <= dark:
            dark = None

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        ends, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])  # the latter where a quote is never closed
        if not tag:
            continue
        tag = tag.lower()
        if ends:
            if tag == "br" and dark is None:
                pieces.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(t in BLOCK for t, _ in stack[i:]):
                        pop(i)
                    else:
                        cut(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break  # an inline element ends only inside its block
            continue
        if tag in RAW:
            if tag == "head":  # ends with its end tag or where the body begins
                m = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = n if not m else m.start() if m[0][1] != "/" else m.end()
            elif not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                at = _after(page, at, tag)
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img") and dark is None:
                pieces.append("" if tag == "wbr" else " ")
            elif tag in BLOCK:
                close()
            continue
        hides = bool(attributes) and hidden(attributes)
        if tag in BLOCK:
            if not hides:
                close()
            if tag in CLOSES_P:
                _leave(stack, ("p",), SCOPES, pop)
            if before := SIBLINGS.get(tag):
                _leave(stack, tuple(before.split()), frozenset(("ul", "ol", "dl", "table", "select")), pop)
            if tag[0] == "h" and tag[1:].isdigit() and stack and stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit():
                pop(len(stack) - 1)
            while stack and stack[-1][0] not in BLOCK and len(stack) - 1 != dark:  # formatting that was left open doesn't hold further blocks, unless it hides them
                cut(len(stack) - 1)
            if not hides:
                close()  # what stands before a hidden element that ended here
        if tag == "a":
            links += 1
        names = tuple(w.lower() for a in ATTRIBUTE.finditer(attributes) for w in NAME_PART.findall(a[2] or a[3] or a[4] or "")) if attributes else ()
        if hides and dark is None:
            dark = len(stack)
        stack.append((tag, names))
    pop(0)
    close()
    return out


def hidden(attributes: str) -> bool:
    """Whether an element's attributes hide it: hidden itself, aria-hidden="true", or a style without display. The words in other attributes' names and values say nothing."""
    if not MAY_HIDE.search(attributes):
        return False
    for m in ANY_ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and NO_DISPLAY.search(value)):
            return True
    return False


def _leave(stack: list, tags: tuple[str, ...], walls: frozenset, pop) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in tags:
            low = i
            while low and stack[low - 1][0] in tags:
                low -= 1
            pop(low if len(tags) > 1 else i)
            return
        if stack[i][0] in walls:
            return


def _after(page: str, at: int, tag: str) -> int:
    """Where what follows an element of raw content begins."""
    m = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    return m.end() if m else len(page)


#: Words that often stand in short blocks of other purposes.
HINTS = frozenset(
    "home about contact menu search login register sign subscribe newsletter cookie cookies consent privacy policy terms copyright rights reserved advertisement sponsored promoted share tweet email print follow"
    " related popular trending recommended read more next previous tags category filed posted author comment comments reply replies says said ago username password submit accept powered skip".split()
)


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    out = []
    for i, b in enumerate(blocks):
        tags = {f"tag {t}" for t, _ in b.path}
        words = {f"name {w}" for _, names in b.path for w in names}
        count = b.text.count(" ") + 1
        if not b.text.isascii():
            count += len(UNSPACED.findall(b.text)) // 2
        f = ["every", f"in {b.path[-1][0] if b.path else ''}", f"words {min(count.bit_length(), 7)}", f"links {3 * b.linked // max(1, len(b.text))}", f"ends {b.text[-1] in ENDS}"]
        if not words and not any(t in NOISE_TAGS for t, _ in b.path):
            f += ["nameless", "nameless prose" if count >= PROSE and 4 * b.linked < len(b.text) and b.text[-1] in ENDS else "nameless else", f"nameless words {min(count.bit_length(), 7)} links {3 * b.linked // max(1, len(b.text))}"]
        if count < PROSE:
            f += sorted({f"says {w}" for w in NAME_PART.findall(b.text.lower()) if w in HINTS})
        if count < PROSE and ("©" in b.text or "copyright" in b.text[:40].lower()):
            f.append("rights")
        if count < PROSE and (i == 0 or i == len(blocks) - 1):
            f.append("first" if i == 0 else "last")
        out.append(f + sorted(tags) + sorted(words))
    return out


# --- training pages ---------------------------------------------------------------------------------

#: Names that pages give to their parts.
MAIN_NAMES = "article;article-body;post-content;entry-content;main-content;story;content;post;blog-post;text;body-text;page-content;news-article"
ASIDE_PARTS = {
    "menu": "menu;navbar;navigation;main-nav;breadcrumbs;site-menu;topnav;toc",
    "head": "header;masthead;site-header;top-bar;banner;page-header",
    "foot": "footer;site-footer;bottom;colophon;copyright;page-footer",
    "side": "sidebar;aside;widget;related;recommended;more-stories;popular;trending;side-column",
    "note": "cookie-notice;cookie-banner;consent;notice;alert;popup;modal;newsletter;subscribe;gdpr;disclaimer;message",
    "ad": "ad;ads;advert;advertisement;sponsored;promo;banner-ad;adsense;sponsor",
    "talk": "comments;comment;comment-list;user-comments;discussion;responses;replies;respond;disqus;reader-comments",
    "form": "form;login;search-form;signup;contact-form;search",
    "share": "share;social;share-buttons;tags;byline;meta;author-box;pagination",
}
ASIDE_TAGS = {"menu": "nav ul div", "head": "header div", "foot": "footer div", "side": "aside div section", "note": "div aside section", "ad": "div aside section", "talk": "section div ol", "form": "form", "share": "div ul"}
#: A character for private use.
MARKED = "\ue000"
NOISE_TAGS = frozenset("nav header footer aside form menu button dialog".split())


def labelled(blocks: list[Block]) -> list[bool] | None:
    """Labels from markup that names the article: inside <article> or <main> and in no element of another purpose; None without such markup."""
    noise = {w for names in ASIDE_PARTS.values() for w in names.split(";") if "-" not in w}
    out, found = [], False
    for b in blocks:
        at = next((i for i, (t, _) in enumerate(b.path) if t in ("article", "main")), None)
        good = at is not None and not any(t in NOISE_TAGS or noise & set(names) for t, names in b.path[at + 1 :])
        found |= good
        out.append(good)
    return out if found else None


#: What such parts often say.
SAYS = {
    "menu": "Home;About us;Contact;Archive;Products;Skip to content;Menu;Shop;Support;Blog;Search",
    "head": "Welcome to our site;Sign in;The daily page;Call us today;Home | About | Contact;Subscribe now",
    "foot": "© 2021 All rights reserved.;Copyright 2019 by the owners;Privacy policy | Terms of use | Contact;Powered by the open web;About us. Imprint. Terms.",
    "side": "Related articles;Most popular;You may also like;Trending now;Recent posts;Recommended for you;Categories",
    "note": "We use cookies to improve this site. Accept;Subscribe to our newsletter;This site needs your consent.;Enter your email to subscribe;You have free articles left this month. Log in to read more.",
    "ad": "Advertisement;Sponsored content;Buy now and save half;Promoted by our partners;Free trial for you today",
    "talk": "3 comments;Leave a reply;Comments are closed.;Reply;Ann says: 2 days ago;Posted by Tom at 10:12",
    "form": "Log in;Username;Search;Your email;Password;Submit;Send us a message",
    "share": "Share this;Tweet;Print;Email;Filed under: news;Tags: one, two;Posted by the author;Next post;Previous post;By Ann Smith, 3 May",
}


def _shape(texts: list[str], kind: str, rng: random.Random) -> str:
    """A part of another purpose, with the given texts or what such parts often say."""
    name = rng.choice(ASIDE_PARTS[kind].split(";"))
    tag = rng.choice(ASIDE_TAGS[kind].split())
    mark = rng.choice(("", f' class="{name}"', f' id="{name}"', f' class="x{rng.randrange(9)} {name}"')) if tag not in ("div", "ul", "ol", "section") else rng.choice((f' class="{name}"', f' id="{name}"'))
    texts = [html.escape(t) if rng.random() < 0.6 else rng.choice(SAYS[kind].split(";")) for t in texts]
    if kind in ("menu", "share"):
        words = (" ".join(texts).split() if rng.random() < 0.5 else SAYS[kind].split(";"))[: rng.randint(3, 8)]
        inner = "".join(f'<li><a href="/">{w}</a></li>' for w in words)
        inner = inner if tag == "ul" else rng.choice((f"<ul>{inner}</ul>", " | ".join(f'<a href="/">{w}</a>' for w in words), "".join(f"<span>{w}</span> " for w in words)))
    elif kind == "form":
        inner = f"<label>{texts[0][:30]}</label><input><p>{texts[-1]}</p><button>{texts[0][:12]}</button>"
    elif kind == "talk":
        said = [rng.choice((f"<p>{t}</p>", f'<span class="author">{t[:9]}</span> <p>{t}</p>', f"<h4>{t[:20]}</h4><div>{t}</div>", t)) for t in texts]
        inner = rng.choice(("", "<h3>Comments</h3>", f"<h2>{rng.randrange(40)} comments</h2>")) + "".join(f'<{u} class="{rng.choice(("comment", "reply", "c", "comment-body"))}">{t}</{u}>' for t in said for u in (rng.choice(("div", "li")),))
    elif kind == "side":
        inner = rng.choice(("", f"<h3>{rng.choice(SAYS[kind].split(';'))}</h3>")) + "".join(rng.choice((f"<p>{t}</p>", f'<h3><a href="/">{t[:60]}</a></h3>', f'<li><a href="/">{t[:50]}</a></li>', f'<div><a href="/">{t[:70]}</a><p>{t[:90]}</p></div>')) for t in texts)
    else:
        inner = rng.choice((f"<p>{texts[0]}</p>", texts[0], f"<span>{texts[0]}</span>", f'{texts[0][:80]} <a href="/">{texts[0][:10]}</a>', f"<div><div>{texts[0]}</div></div>"))
    return f"<{tag}{mark}>{inner}</{tag}>"


def _unnamed(kind: str, rng: random.Random) -> str:
    """A short part of another purpose in an element without a name."""
    tag, says = rng.choice(("div", "p", "center", "h3")), SAYS[kind].split(";")
    inner = " ".join(f'<a href="/">{w}</a>' for w in rng.sample(says, 4)) if kind == "menu" else invented(rng, rng.randint(2, 4)).title().rstrip(".") if kind == "head" else rng.choice(says)
    return f"<{tag}>{inner}</{tag}>"


SYLLABLES = "ba re mi no tu la che ster ing on er th ou vi do pa ne su ri go".split()


def invented(rng: random.Random, n: int) -> str:
    """Prose of n words that mean nothing."""
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3)))) for _ in range(n)]
    out, start = [], True
    for w in words:
        out.append(w.capitalize() if start or rng.random() < 0.05 else w)
        start = rng.random() < 0.08
        out[-1] += "." if start else "," if rng.random() < 0.06 else ""
    return " ".join(out).rstrip(".,") + "."


def invented_article(rng: random.Random) -> list[tuple[str, str]]:
    """Blocks (tag, text) of an article: a heading, paragraphs long and short, now and then lists, quotations, tables' rows and lines of code."""
    if rng.random() < 0.2:  # a page of one or two blocks
        return [("p", invented(rng, rng.choice((5, 10, 20, 40, 80)))) for _ in range(rng.randint(1, 2))]
    out = [(rng.choice(("h1", "h1", "h2")), invented(rng, rng.randint(2, 9)).rstrip("."))] if rng.random() < 0.85 else []
    for _ in range(rng.randint(2, 8)):
        out.append(("p", invented(rng, rng.choice((3, 8, 20, 40, 80)))))
        if rng.random() < 0.3:
            tag = rng.choice(("h2", "h3", "li", "li", "blockquote", "pre", "figcaption", "td", "div"))
            out += [(tag, invented(rng, rng.randint(2, 14)).rstrip("." if rng.random() < 0.5 else ",")) for _ in range(rng.randint(2, 4) if tag in ("li", "td", "pre") else 1)]
    return out


def _inline(text: str, rng: random.Random) -> str:
    """Some words in formatting or a link."""
    words = text.split(" ")
    if len(words) > 6 and rng.random() < 0.3:
        at = rng.randrange(len(words) - 2)
        words[at] = rng.choice(('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", '<span class="hl">{}</span>')).format(words[at])
    return " ".join(words)


def other_layout(main: list[tuple[str, str]], noise: list[str], rng: random.Random) -> tuple[str, int]:
    """A page with the given article (tag, text) and parts of other purposes made of the noise texts; and the number of article blocks."""
    some = lambda: [rng.choice(noise) for _ in range(rng.randint(1, 3))]
    tag = rng.choice(("article", "main", "div", "div", "section", "td"))
    name = rng.choice(MAIN_NAMES.split(";"))
    mark = "" if tag in ("article", "main") and rng.random() < 0.6 else rng.choice((f' class="{name}"', f' id="{name}"'))
    plain = rng.random() < PLAIN  # the article stands in the body by itself, or in an element without a name
    calm = 0.4 if plain else 1.0
    bare = rng.random() < (0.5 if plain else 0.25)  # paragraphs that are divs or parted by line breaks alone
    wrap = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}
    inner = [wrap.get(t, f"<{t}>{{}}</{t}>" if not bare or t != "p" else "<div>{}</div>").format(_inline(html.escape(x), rng)) for t, x in main]
    if rng.random() < 0.15:  # a section for some of the blocks
        at = rng.randrange(len(inner) + 1)
        inner[at:] = [f"<{rng.choice(('section', 'div'))}>", *inner[at:], "</section></div>"]
    for kind in ("ad", "share", "side", "note", "talk", "form"):
        if rng.random() < 0.2 * calm:
            inner.insert(len(inner) if kind in ("talk", "share") else rng.randint(0, len(inner)), _shape(some(), kind, rng))
    before = [_shape(some(), k, rng) for k in ("head", "menu", "note", "ad", "form", "side") if rng.random() < 0.5 * calm]
    after = [_shape(some(), k, rng) for k in ("ad", "share", "talk", "side", "form", "note", "menu", "foot") if rng.random() < 0.5 * calm]
    if plain:
        before += [_unnamed(k, rng) for k in ("head", "menu", "share") if rng.random() < 0.3]
        after = [_unnamed(k, rng) for k in ("share", "menu", "foot") if rng.random() < 0.3] + after
    if plain and len(main) == 1 and rng.random() < 0.3:
        inner = [html.escape(main[0][1])]  # text without any element
    if plain:
        tag, mark = rng.choice(("", "", "", "div", "section", "center")), ""
    body = f"<{tag}{mark}>{''.join(inner)}</{tag}>" if tag else "".join(inner)
    body = f"<table><tr>{body}</tr></table>" if tag == "td" else body
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(("wrapper", "container", "page", "row", "site"))}">{body}</div>'
    if rng.random() < 0.3:  # side columns inside the same wrapper
        body = f'<div id="{rng.choice(("wrapper", "container", "columns", "layout", "content-wrapper"))}">{_shape(some(), "side", rng)}{body}{_shape(some(), "side", rng)}</div>'
    whole = f"{''.join(before)}{body}{''.join(after)}"
    return whole if plain and rng.random() < 0.3 else f"<html><body>{whole}</body></html>", len(main)


def training_set(pages: list[str], copies: int = COPIES, seed: int = 1) -> list[tuple[list[list[str]], list[bool]]]:
    """Features and labels of the blocks of labelled pages, and of their copies in other layouts."""
    rng = random.Random(seed)
    read = [(b, y) for b in map(leaf_blocks, pages) if (y := labelled(b))]
    noise = [b.text for blocks, y in read for b, good in zip(blocks, y, strict=True) if not good or rng.random() < 0.2]
    out = [(block_features(b), y) for b, y in read]
    for blocks, y in read:
        main = [(b.path[-1][0] if b.path[-1][0] in ("p", "h1", "h2", "h3", "li", "blockquote", "pre") else "p", b.text) for b, good in zip(blocks, y, strict=True) if good]
        out += [_laid_out(main, noise, rng) for _ in range(copies if noise else 0)]
    return out


def invented_set(n: int = INVENTED, seed: int = 5) -> list[tuple[list[list[str]], list[bool]]]:
    """Features and labels of pages of invented prose."""
    rng = random.Random(seed)
    noise = [invented(rng, rng.choice((2, 4, 9, 25, 50))) for _ in range(200)]
    return [_laid_out(invented_article(rng), noise, rng) for _ in range(n)]


def _laid_out(main: list[tuple[str, str]], noise: list[str], rng: random.Random) -> tuple[list[list[str]], list[bool]]:
    # a mark in the text tells the article's blocks when the page is read again
    page, _ = other_layout([(t, MARKED + x) for t, x in main], noise, rng)
    blocks = leaf_blocks(page)
    labels = [MARKED in b.text for b in blocks]
    return block_features([b._replace(text=b.text.replace(MARKED, "").strip() or ".") for b in blocks]), labels


# --- the field --------------------------------------------------------------------------------------


class Field:
    """Weights of features for each label, of neighbouring labels, and of the first label."""

    def __init__(self, names: list[str], emit: np.ndarray, step: np.ndarray, begin: np.ndarray):
        self.number = {n: i for i, n in enumerate(names)}
        self.emit, self.step, self.begin = emit, step, begin

    def labels(self, rows: list[list[str]]) -> list[bool]:
        """The most probable labels (Viterbi)."""
        if not rows:
            return []
        score = [self.emit[[self.number[f] for f in row if f in self.number]].sum(axis=0) for row in rows]
        best, back = self.begin + score[0], []
        for s in score[1:]:
            ways = best[:, None] + self.step
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + s
        label = int(best.argmax())
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return [x == 1 for x in reversed(out)]


def marginals(s: np.ndarray, real: np.ndarray, step: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each page the logarithm of the sum over all paths, of each block the probability of its labels, and of each block but the last
    that of its label and the next. s: scores by page, block and label; real: which blocks there are, from the first on."""
    longest, pairs = s.shape[1], real[:, 1:] & real[:, :-1]
    ahead, after = np.zeros_like(s), np.zeros_like(s)
    ahead[:, 0] = begin + s[:, 0]
    for i in range(1, longest):
        ways = np.logaddexp.reduce(ahead[:, i - 1, :, None] + step, axis=1) + s[:, i]
        ahead[:, i] = np.where(real[:, i, None], ways, ahead[:, i - 1])
    for i in range(longest - 2, -1, -1):
        ways = np.logaddexp.reduce(step + (s[:, i + 1] + after[:, i + 1])[:, None, :], axis=2)
        after[:, i] = np.where(real[:, i + 1, None], ways, 0)
    z = np.logaddexp.reduce(ahead[:, -1], axis=1)
    p = np.exp(ahead + after - z[:, None, None]) * real[:, :, None]
    joint = np.exp(ahead[:, :-1, :, None] + step + (s[:, 1:] + after[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
    return z, p, joint


def train(pages: list[tuple[list[list[str]], list[bool]]], rounds: int = ROUNDS) -> Field:
    """The field of least penalised negative log likelihood, by Adagrad over all pages at once."""
    counts: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, c in counts.items() if c >= LEAST_COUNT)
    number = {f: i for i, f in enumerate(names)}
    longest = max((len(y) for _, y in pages), default=1)
    n = len(pages)
    real = np.zeros((n, longest), bool)
    truth = np.zeros((n, longest), np.int64)
    at, cell = [], []
    for p, (rows, y) in enumerate(pages):
        real[p, : len(y)] = True
        truth[p, : len(y)] = y
        for i, row in enumerate(rows):
            for f in row:
                if f in number:
                    at.append(number[f])
                    cell.append(p * longest + i)
    at, cell = np.array(at, np.int64), np.array(cell, np.int64)
    emit, step, begin = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full(x.shape, 1e-8) for x in (emit, step, begin)]
    gold = np.eye(2)[truth] * real[:, :, None]
    pairs = real[:, 1:] & real[:, :-1]
    gold_step = np.einsum("pi,pia,pib->ab", pairs, gold[:, :-1], gold[:, 1:]) if n else step
    for _ in range(rounds if n else 0):
        s = np.stack([np.bincount(cell, emit[at, k], minlength=n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        _, p, joint = marginals(s, real, step, begin)
        off = (p - gold).reshape(-1, 2)
        slopes = [np.stack([np.bincount(at, off[cell, k], minlength=len(names)) for k in (0, 1)], axis=1) / n + L2 * emit, (joint.sum(axis=(0, 1)) - gold_step) / n, (p[:, 0] - gold[:, 0]).sum(axis=0) / n]
        for x, g, q in zip((emit, step, begin), slopes, seen, strict=True):
            q += g * g
            x -= RATE * g / np.sqrt(q)
    return Field(names, emit, step, begin)


def sample(pages: DataFrame, max_train: int = MAX_TRAIN) -> list[str]:
    """At most max_train pages that name their article, those with the least hashes of the whole row, each once.

    Hashes alone are ranked; then only the pages under the last of these come to the driver."""
    key = F.xxhash64(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)), "html")
    named = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b")).select(key.alias("key"), "html")
    least = [r["key"] for r in named.select("key").distinct().orderBy("key").limit(max_train).collect()]
    if not least:
        return []
    rows = named.where(F.col("key") <= least[-1]).groupBy("key").agg(F.min("html").alias("html")).collect()  # max_train rows
    return [r["html"] for r in sorted(rows, key=lambda r: r["key"])]


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page)
    keep = field.labels(block_features(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page: the main blocks' texts in order, joined by \\n.

    pages: page_id, url, html. Null and empty pages, and pages without a main block, give an empty text; repeated rows and
    null ids are rows like others; whole pages are read whatever their length; an empty table gives an empty
    result; other columns aren't read. Of labels with equal scores the path that keeps less is taken. Without a field one is trained on invented pages
    and, where pages of the table name their article, on a sample of these."""
    shared = pages.sparkSession.sparkContext.broadcast(field or train(invented_set() + training_set(sample(pages))))  # some thousand weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = [main_text(x or "", field) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(work, "page_id long, url string, text string, n_chars long")
