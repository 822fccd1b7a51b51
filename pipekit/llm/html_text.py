"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with the path of open elements.  Each block
gets binary features (ancestor tags, the words of ancestors' class, id and role, link density, length, punctuation,
neighbouring form), and a two-label chain (main text or not) is trained on labelled pages by gradient steps on the
exact log-likelihood and decoded by Viterbi.

Labelled pages: a bounded sample of the table's own pages whose markup states the parts (an ``article`` or ``main``
element, ``nav``, ``footer`` and so on), each used as it is and re-dressed in other templates: other containers and
class names for the article, and added menus, notices, sidebars, adverts, forms and reader comments, whose blocks
are labelled by construction.  ``training_pages`` bounds the sample; its features (hashed to ``2 ** FEATURE_BITS``
weights) bound the model.

NULL and empty pages give the empty text.  Character references are decoded, white space inside a block becomes one
space, blocks are joined by a line feed.  Scripts, styles, comments and the head never give blocks.  Unclosed tags
end with their parents; an unclosed head ends with the first tag that does not belong there, an unclosed list of
choices, button or drawing with the first block.  Reading a page takes time in proportion to its length, however deep or
broken it is.  Extra columns are ignored; repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 60
#: Longer pages train only if there are not enough shorter ones, and then by this many of their blocks.
TRAINING_CHARS = 30_000
TRAINING_BLOCKS = 400
FEATURE_BITS = 14
ROUNDS = 20

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_HIDDEN = frozenset("script style noscript template svg math iframe object head title textarea select button".split())
#: Hidden elements that stand within a line: they neither end a block nor a paragraph.
_PHRASING = _INLINE | _HIDDEN - {"head", "title"}
#: What a head may hold; any other tag ends it.
_HEAD = frozenset("head title meta link base script style noscript template".split())
#: Hidden elements that a block ends if they are open.
_OPEN_ENDED = frozenset("select button svg math object".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
_RAW = frozenset("script style textarea title iframe noscript".split())
_CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_STOPS = frozenset("ul ol dl table tbody thead article section div main body form nav aside footer header select".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_TAG_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    """``leaf`` is the innermost open element, ``tags`` are all of them, ``names`` their class, id and role words."""

    text: str
    leaf: str
    tags: frozenset[str]
    names: frozenset[str]
    linked: int


def _tag_end(page: str, at: int) -> int:
    """Where a tag ends, past quoted values; -1 if it does not.  A quote without its partner is an ordinary character, which
    can happen once per kind of quote; so the search stays linear."""
    while found := _TAG_STOP.search(page, at):
        if found[0] == ">":
            return found.end()
        partner = page.find(found[0], found.end())
        if partner < 0:
            return page.find(">", found.end()) + 1 or -1
        at = partner + 1
    return -1


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in page order."""
    if not page:
        return []
    out: list[Block] = []
    # Open elements: tag, innermost element that is not inline, and all tags and names so far; these are shared with the
    # parent where the element adds nothing.
    nothing = frozenset()
    stack: list[tuple[str, str, frozenset[str], frozenset[str]]] = []
    opened: Counter[str] = Counter()
    hidden = linked = 0
    pieces: list[str] = []

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                _, leaf, tags, names = stack[-1] if stack else ("", "", nothing, nothing)
                out.append(Block(text, leaf, tags, names, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal hidden
        tag = stack[-1][0]
        if tag not in _PHRASING and not hidden:  # what is hidden breaks no line
            flush()
        stack.pop()
        opened[tag] -= 1
        hidden -= tag in _HIDDEN

    def pop_through(tag: str) -> None:
        while stack[-1][0] != tag:
            pop()
        pop()

    at, n = 0, len(page)
    while at < n:
        match = _TOKEN.search(page, at)
        end = match.start() if match else n
        if end > at and not hidden:
            piece = page[at:end]
            pieces.append(piece)
            if opened["a"]:
                linked += len(piece)
        if not match:
            break
        at = match.end()
        name = match[2]
        if name is None:
            continue
        until = _tag_end(page, at)
        if until < 0:  # the page ends within a tag
            break
        attributes, at = page[at : until - 1], until
        tag = name.lower()
        if match[1]:
            if opened[tag]:
                pop_through(tag)
            elif tag not in _PHRASING and not hidden:
                flush()
            continue
        if opened["head"] and tag not in _HEAD:
            pop_through("head")
        if tag in _BLOCKS:
            while ended := next((t for t in _OPEN_ENDED if opened[t]), None):
                pop_through(ended)
        if tag in ("br", "wbr", "img"):
            if tag == "br" and not hidden:
                pieces.append(" ")
            continue
        if tag not in _PHRASING and not hidden:
            flush()
            while stack and stack[-1][0] in _INLINE:  # unclosed inline elements end with their block
                pop()
            if stack and stack[-1][0] == "p":
                pop()
            if any(opened[t] for t in _CLOSES.get(tag, ())):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in _CLOSES[tag]:
                        while len(stack) > depth:
                            pop()
                        break
                    if stack[depth][0] in _STOPS:
                        break
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag in _RAW:
            closing = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = closing.end() if closing else n
            continue
        _, leaf, tags, names = stack[-1] if stack else ("", "", nothing, nothing)
        if tag not in _INLINE:
            leaf = tag
            tags = tags if tag in tags else tags | {tag}
            found = _NAMES.findall(attributes) if attributes else ()
            own = {p for group in found for value in group for p in _PARTS.findall(value.lower())}
            names = names if own <= names else names | own
        stack.append((tag, leaf, tags, names))
        opened[tag] += 1
        hidden += tag in _HIDDEN
    while stack:
        pop()
    flush()
    return out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << FEATURE_BITS) - 1)


_SLOTS: dict[str, int] = {}


def _slots(names: list[str]) -> list[int]:
    if len(_SLOTS) > 200_000:
        _SLOTS.clear()
    out = []
    for n in names:
        slot = _SLOTS.get(n)
        if slot is None:
            slot = _SLOTS[n] = _slot(n)
        out.append(slot)
    return out


@lru_cache(maxsize=4096)
def _place_slots(leaf: str, tags: frozenset[str], names: frozenset[str]) -> list[int]:
    """Of the ancestors' tags and names, which many blocks share."""
    found = ["bias", f"leaf:{leaf}"]
    found += [f"in:{t}" for t in sorted(tags)]
    return _slots(found + [f"name:{n}" for n in sorted(names)])


def features(page: list[Block]) -> list[list[int]]:
    """Feature indices of each block."""
    out = []
    for i, b in enumerate(page):
        n = len(b.text)
        names = []
        names.append(f"length:{min(n.bit_length(), 9)}")
        names.append(f"links:{4 * b.linked // n}")
        names.append(f"end:{b.text[-1] if not b.text[-1].isalnum() else 'a'}")
        if "©" in b.text[:3]:
            names.append("copyright")
        names.append("first" if i == 0 else "last" if i == len(page) - 1 else "inner")
        out.append(_place_slots(b.leaf, b.tags, b.names) + _slots(names))
    return out


@dataclass(frozen=True)
class Chain:
    """``emit[label, feature]`` and ``move[label, label]``."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, page: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((f for block in page for f in block), dtype=np.int64)
        starts = np.cumsum([0] + [len(f) for f in page[:-1]])
        return np.add.reduceat(self.emit[:, flat], starts, axis=1).T

    def decode(self, page: list[list[int]]) -> list[int]:
        """Viterbi; ties go to label 0."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            stay0, from1 = a + m00, b + m10
            to1, stay1 = a + m01, b + m11
            back.append((int(from1 > stay0), int(stay1 > to1)))
            a, b = max(stay0, from1) + x, max(to1, stay1) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def _posterior(s: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and transition marginals of one page (forward-backward)."""
    n = len(s)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = s[0]
    for i in range(1, n):
        forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + move, axis=0) + s[i]
    for i in range(n - 2, -1, -1):
        backward[i] = np.logaddexp.reduce(move + (s[i + 1] + backward[i + 1])[None, :], axis=1)
    z = np.logaddexp.reduce(forward[-1])
    single = np.exp(forward + backward - z)
    double = np.zeros((2, 2))
    for i in range(1, n):
        double += np.exp(forward[i - 1][:, None] + move + (s[i] + backward[i])[None, :] - z)
    return single, double


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, decay: float = 1e-3) -> Chain:
    """Weights by AdaGrad on the exact log-likelihood; the order of the pages is theirs, so reruns agree."""
    size = 1 << FEATURE_BITS
    emit, move = np.zeros((2, size)), np.zeros((2, 2))
    g_emit, g_move = np.full((2, size), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        for page, labels in pages:
            if not page:
                continue
            chain = Chain(emit, move)
            single, double = _posterior(chain.scores(page), move)
            d_move = -double
            for a, b in zip(labels, labels[1:]):
                d_move[a, b] += 1
            flat = np.fromiter((f for fs in page for f in fs), dtype=np.int64)
            owner = np.repeat(np.arange(len(page)), [len(f) for f in page])
            target = np.zeros((len(page), 2))
            target[np.arange(len(page)), labels] = 1
            error = (target - single)[owner]
            touched, where = np.unique(flat, return_inverse=True)
            for label in (0, 1):
                d = np.bincount(where, weights=error[:, label], minlength=len(touched)) - decay * emit[label, touched]
                g_emit[label, touched] += d * d
                emit[label, touched] += 0.5 * d / np.sqrt(g_emit[label, touched])
            g_move += d_move * d_move
            move = move + 0.5 * d_move / np.sqrt(g_move)
    return Chain(emit, move)


# Parts of a page by its own markup, for labels.
_MAIN = frozenset(["article", "main"])
_OTHER = frozenset("nav footer aside header form menu dialog".split())
_OTHER_NAMES = frozenset("ad ads advert comment comments sidebar menu nav footer notice cookie banner share related promo".split())


def stated_labels(page: list[Block]) -> list[int]:
    """1 inside an article or main element and outside what is marked as something else."""
    return [int(bool(_MAIN & b.tags) and not _OTHER & b.tags and not _OTHER_NAMES & b.names) for b in page]


# Usual element and class names of page templates.
_ARTICLES = (
    ("article", ""), ("article", ' class="post"'), ("main", ""), ("main", ' id="content"'), ("div", ' class="content"'),
    ("div", ' id="main"'), ("div", ' class="entry-content"'), ("div", ' class="post-body"'), ("section", ' class="article-body"'),
    ("div", ' class="story"'), ("div", ' role="main"'), ("div", ' class="article"'), ("div", ' class="text"'),
)
_MENUS = (
    ("nav", ""), ("div", ' class="menu"'), ("div", ' id="navigation"'), ("ul", ' class="nav"'), ("header", ""),
    ("div", ' class="navbar"'), ("div", ' class="breadcrumbs"'), ("div", ' class="header"'), ("div", ' id="topbar"'),
)
_NOTES = (
    ("div", ' class="ad"'), ("div", ' class="advert"'), ("div", ' class="advertisement"'), ("div", ' class="cookie-notice"'),
    ("div", ' class="banner"'), ("div", ' class="notice"'), ("div", ' class="promo"'), ("div", ' class="sponsored"'),
    ("aside", ""), ("div", ' class="sidebar"'), ("aside", ' class="related"'), ("div", ' id="sidebar"'), ("div", ' class="widget"'),
    ("div", ' class="share"'), ("div", ' class="newsletter"'), ("form", ""), ("div", ' class="popup"'), ("div", ' class="alert"'),
    ("div", ' class="consent"'), ("div", ' role="alert"'), ("div", ' class="ads"'), ("div", ' id="cookies"'),
    ("div", ' class="cookie"'), ("div", ' class="cookie-bar"'), ("div", ' class="gdpr"'), ("div", ' class="subscribe"'),
    ("div", ' class="social"'), ("div", ' class="ad-box"'), ("div", ' class="adsbygoogle"'), ("div", ' class="signup"'),
)
_COMMENTS = (
    ("div", ' class="comments"'), ("section", ' id="comments"'), ("div", ' class="comment"'), ("ol", ' class="comment-list"'),
    ("div", ' id="disqus"'), ("section", ' class="reader-comments"'), ("ul", ' class="replies"'), ("div", ' class="discussion"'),
)
_FOOTERS = (
    ("footer", ""), ("div", ' class="footer"'), ("div", ' id="footer"'), ("div", ' class="copyright"'), ("div", ' class="legal"'),
)


def _element(kind: tuple[str, str], inside: str) -> str:
    return f"<{kind[0]}{kind[1]}>{inside}</{kind[0]}>"


def redress(page: list[Block], labels: list[int], rng: random.Random) -> tuple[list[list[int]], list[int]]:
    """The page's blocks in another template, with their labels."""
    main = [b.text for b, y in zip(page, labels, strict=True) if y][:40]  # a template's article is of usual length
    rest = [b.text for b, y in zip(page, labels, strict=True) if not y] or ["Home"]

    def prose() -> str:
        return html.escape(rng.choice([*main, *rest]))

    def other() -> str:
        return html.escape(rng.choice(rest))

    def items(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{other()[:20]}</a></li>' for _ in range(n)) + "</ul>"

    heading = rng.choice(("h1", "h2", "h1"))
    body = [f"<{heading}>{html.escape(main[0])}</{heading}>" if main else ""]
    for t in main[1:] or main:
        body.append(_element((rng.choice(("p", "p", "p", "blockquote", "div")), ""), html.escape(t)))
        if rng.random() < 0.08:
            body.append(_element(rng.choice(_NOTES), f"<p>\x01{prose()}</p>"))
    if rng.random() < 0.3:
        lis = "".join(f"<li>{html.escape(t[:120])}</li>" for t in main[:3])
        body.append(f"<ul>{lis}</ul>")
    comments = _element(rng.choice(_COMMENTS), "".join(f"<p>\x01{prose()}</p>" for _ in range(rng.randint(1, 3))))
    if rng.random() < 0.25:
        body.append(comments)
        comments = ""
    parts = [_element(rng.choice(_MENUS), items(rng.randint(2, 6)).replace(">", ">\x01"))]
    parts += [_element(rng.choice(_NOTES), f"<p>\x01{prose()}</p>") for _ in range(rng.randint(0, 3))]
    article = _element(rng.choice(_ARTICLES), "".join(body))
    parts.append(_element(("div", rng.choice(("", ' class="wrapper"', ' id="page"', ' class="container"'))), article))
    parts += [_element(rng.choice(_NOTES), f"\x01{prose()}") for _ in range(rng.randint(0, 2))]
    parts += [comments] if rng.random() < 0.7 else []
    parts.append(_element(rng.choice(_FOOTERS), f"\x01&copy; {other()}"))
    found = blocks(f"<html><body>{''.join(parts)}</body></html>")
    marked = [int("\x01" not in b.text) for b in found]
    clean = [Block(b.text.replace("\x01", "").strip() or "-", b.leaf, b.tags, b.names, b.linked) for b in found]
    return features(clean), marked


def fit(
    pages: DataFrame,
    *,
    page_html: str = "html",
    training_pages: int = TRAINING_PAGES,
    training_chars: int = TRAINING_CHARS,
    training_blocks: int = TRAINING_BLOCKS,
    dresses: int = 4,
    seed: int = 7,
) -> Chain:
    """A chain trained on at most ``training_pages`` different pages that state an article, and their other dresses.  Pages
    of fewer than ``training_chars`` characters come first; of a page, a run of at most ``training_blocks`` blocks is learnt."""
    stated = F.lower(F.col(page_html)).rlike("<(article|main)[ >]")
    long = F.length(page_html) >= training_chars
    # The smallest content hashes: a bounded sample that does not depend on the order of the rows.  Copies of a page share
    # one hash and are one page; narrow rows are ranked, and only the chosen pages leave their tasks, once each.
    hashed = pages.filter(stated).select(F.xxhash64(page_html).alias("h"), long.alias("long"), F.col(page_html).alias("page"))
    chosen = [row.h for row in hashed.select("h", "long").distinct().orderBy("long", "h").limit(training_pages).collect()]
    rows = sorted(hashed.filter(F.col("h").isin(chosen)).dropDuplicates(["h"]).collect(), key=lambda r: r.h) if chosen else []
    rng = random.Random(seed)
    examples = []
    for row in rows:
        found = blocks(row.page)
        first = rng.randrange(len(found) - training_blocks) if len(found) > training_blocks else 0
        found = found[first : first + training_blocks]
        labels = stated_labels(found)
        examples.append((features(found), labels))
        examples += [redress(found, labels, rng) for _ in range(dresses)]
    if not examples:  # nothing states its parts: the templates alone
        plain = [
            Block("Some plain text stands here.", "p", frozenset(["p"]), frozenset(), 0),
            Block("Home", "li", frozenset(["li"]), frozenset(), 4),
        ]
        examples = [redress(plain, [1, 0], rng) for _ in range(200)]
    return train(examples)


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, y in zip(found, chain.decode(features(found)), strict=True) if y)


def extract(
    pages: DataFrame, chain: Chain, *, page_id: str = "page_id", url: str = "url", page_html: str = "html"
) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``."""
    emit, move = chain.emit.astype(np.float32), chain.move
    used = np.flatnonzero(np.abs(emit).sum(axis=0))
    weights = emit[:, used]

    def run(batches):
        full = np.zeros((2, 1 << FEATURE_BITS))
        full[:, used] = weights
        own = Chain(full, move)
        for batch in batches:
            texts = [main_text(p, own) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page_html))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
