"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read once, tag by tag, with a stack of open elements; a leaf block is the text between two
block-level tags. Its features are the tags and the words of class, id and role of all its ancestors,
and properties of its text. The field has two labels, main text and boilerplate, with weights for
features and for label changes; it is fitted by maximum likelihood (forward-backward) on labelled
pages and decoded by Viterbi. The text is that of the blocks labelled main, in page order.

Labelled pages are laid out by `labelled_pages` from common page layouts; other labelled pages can be
given to `fit`. Fitting takes about a second on the driver; extraction is one pass in Arrow batches.
Reading is linear in the page also for broken markup: every character is passed once.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trawlspark.llm.stage import ship

# Element kinds of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small "
    "span strike strong sub sup time tt u var wbr object canvas math semantics annotation mrow mi mn mo ms mtext mspace "
    "mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom mfenced menclose".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template title textarea select option svg iframe".split())
RAW = frozenset("script style title textarea iframe".split())
TAGS = (
    "article main section nav header footer aside form ul ol li table td th dl blockquote figure figcaption pre "
    "h1 h2 h3 h4 p div address button dialog details fieldset"
).split()
# Words of class, id and role, by what they tell; words of one group share a feature.
WORDS = {
    "article": "article content post entry story body main text prose",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toolbar skip tabs",
    "header": "header head masthead logo topbar branding",
    "footer": "footer foot copyright legal imprint colophon contentinfo",
    "side": "sidebar side aside widget rail secondary complementary",
    "comment": "comment comments commentlist reply replies discussion discuss disqus thread respond",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner",
    "notice": "notice disclaimer warning cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup paywall message",
    "form": "form login search contact input",
    "share": "share sharing social follow related recommended more tags tag trending popular",
    "byline": "byline author meta date published",
}
_GROUP = {w: g for g, ws in WORDS.items() for w in ws.split()}
_TEXT = (
    "words0 words3 words7 words16 words40 link0 link30 link70 link100 sentence copyright bars start end after_hidden same_parent bias"
).split()
NAMES = [f"tag:{t}" for t in TAGS] + [f"word:{g}" for g in WORDS] + [f"text:{t}" for t in _TEXT]
_INDEX = {n: i for i, n in enumerate(NAMES)}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Block:
    text: str
    features: list[int]
    label: int | None  # of labelled pages


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag, past quoted attribute values; the page's length if none."""
    n = len(page)
    while True:
        end = page.find(">", at)
        if end < 0:
            return n
        quote = _first_quote(page, at, end)
        if quote < 0:
            return end
        at = page.find(page[quote], quote + 1)
        if at < 0:
            return n
        at += 1


_QUOTE = re.compile(r"""=\s*(["'])""")


def _first_quote(page: str, at: int, end: int) -> int:
    found = _QUOTE.search(page, at, end)
    return found.start(1) if found else -1


def _groups(attributes: str) -> tuple[list[int], int | None]:
    found, label = set(), None
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-y":
            label = int(value) if value in ("0", "1") else None  # of labelled pages; given ones may hold anything
            continue
        for word in _SPLIT.split(_CAMEL.sub(" ", value).lower()):
            if word in _GROUP:
                found.add(_INDEX[f"word:{_GROUP[word]}"])
    return list(found), label


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Comments, declarations, scripts, styles and other elements
    that are not shown are left out; what an unclosed one opens is not shown up to the page's end."""
    out: list[Block] = []
    stack: list[tuple[str, list[int], int | None]] = []
    open_tags: dict[str, int] = {}
    active: dict[int, int] = {}
    hidden = links = 0
    parts: list[str] = []
    linked = 0
    after_hidden = False
    labels: list[int] = []
    opened = 0  # number of the innermost open block element
    last_parent = -1
    parents: list[int] = [0]
    counter = 0

    def push(name: str, attributes: str) -> None:
        nonlocal hidden, links, counter
        found, label = _groups(attributes) if attributes else ([], None)
        if f"tag:{name}" in _INDEX:
            found = [*found, _INDEX[f"tag:{name}"]]
        for f in found:
            active[f] = active.get(f, 0) + 1
        if label is not None:
            labels.append(label)
        stack.append((name, found, label))
        open_tags[name] = open_tags.get(name, 0) + 1
        hidden += name in HIDDEN
        links += name == "a"
        if name not in INLINE:
            counter += 1
            parents.append(counter)

    def pop() -> str:
        nonlocal hidden, links
        name, found, label = stack.pop()
        for f in found:
            active[f] -= 1
            if not active[f]:
                del active[f]
        if label is not None:
            labels.pop()
        open_tags[name] -= 1
        hidden -= name in HIDDEN
        links -= name == "a"
        if name not in INLINE:
            parents.pop()
        return name

    def flush() -> None:
        nonlocal parts, linked, last_parent, after_hidden
        if not parts:
            return
        raw = "".join(parts)
        text = " ".join(raw.split())
        if text:
            words, share = text.count(" ") + 1, linked / max(len(raw), 1)
            found = [*active]
            size = "words0" if words < 3 else "words3" if words < 7 else "words7" if words < 16 else "words16" if words < 40 else "words40"
            link = "link0" if share == 0 else "link30" if share < 0.3 else "link70" if share < 0.7 else "link100"
            named = ["bias", size, link]
            if text[-1] in ".!?。\"”":
                named.append("sentence")
            if "©" in text[:40] or "copyright" in text[:60].lower():
                named.append("copyright")
            if "|" in text or "·" in text:
                named.append("bars")
            if parents[-1] == last_parent:
                named.append("same_parent")
            if after_hidden:
                named.append("after_hidden")
            out.append(Block(text, found + [_INDEX[f"text:{t}"] for t in named], labels[-1] if labels else None))
            last_parent, after_hidden = parents[-1], False
        parts, linked = [], 0

    at, n = 0, len(page)
    while at < n:
        less = page.find("<", at)
        stop = n if less < 0 else less
        if stop > at and not hidden:
            text = page[at:stop]
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text)
        if less < 0:
            break
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4 if page[less + 4 : less + 5] != ">" else less + 2)
            at = n if end < 0 else end + 3
            continue
        if page[less + 1 : less + 2] in ("!", "?"):
            end = page.find(">", less)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("/", less + 1)
        named = _NAME.match(page, less + 1 + closing)
        if not named:
            if not hidden:
                parts.append("<")
            at = less + 1
            continue
        name = named[0].lower()
        end = _tag_end(page, named.end())
        attributes = page[named.end() : end]
        at = end + 1
        if name not in INLINE:
            flush()
        elif name == "br" and not hidden:
            parts.append(" ")
        if closing:
            if open_tags.get(name):
                while pop() != name:
                    pass
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or name not in INLINE and open_tags.get("p"):
            # an open paragraph ends here; list items and cells end at the next of their list or row
            closes = "p" if open_tags.get("p") and name not in VOID else name
            if open_tags.get(closes) and _same_scope(stack, closes):
                while pop() != closes:
                    pass
        if name in VOID or attributes.endswith("/") and name in ("svg", "math"):
            continue
        push(name, attributes)
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            at = close.start() if close else n
            after_hidden = after_hidden or name in ("script", "style")
    flush()
    edge = max(len(out) // 10, 1)
    for b in out[:edge]:
        b.features.append(_INDEX["text:start"])
    for b in out[-edge:]:
        b.features.append(_INDEX["text:end"])
    return out


_SCOPE = frozenset("ul ol table dl div section article main body td".split())


def _same_scope(stack: list, name: str) -> bool:
    """Is the innermost `name` open without a container around what stands between?"""
    for tag, _, _ in reversed(stack[-64:]):
        if tag == name:
            return True
        if tag in _SCOPE:
            return False
    return False


@dataclass
class Field:
    weights: np.ndarray  # feature x label
    change: np.ndarray  # label x next label
    first: np.ndarray

    def scores(self, found: list[Block]) -> np.ndarray:
        return np.array([self.weights[b.features].sum(axis=0) for b in found])

    def viterbi(self, found: list[Block]) -> list[int]:
        """The most probable labels."""
        s = self.scores(found).tolist()
        (c00, c01), (c10, c11) = self.change.tolist()
        a, b = s[0][0] + self.first[0], s[0][1] + self.first[1]
        back = []
        for x, y in s[1:]:
            to0, to1 = a + c00 >= b + c10, a + c01 >= b + c11
            back.append((0 if to0 else 1, 0 if to1 else 1))
            a, b = (a + c00 if to0 else b + c10) + x, (a + c01 if to1 else b + c11) + y
        label = [0 if a >= b else 1]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]


def fit(pages: list[list[Block]], rounds: int = 200, decay: float = 0.02, rate: float = 0.5) -> Field:
    """Maximum likelihood with a quadratic penalty, by AdaGrad over all labelled pages at once."""
    pages = [p for p in pages if p]
    longest, count = max(map(len, pages)), len(pages)
    x = np.zeros((count, longest, len(NAMES)), dtype=np.float32)
    y, mask = np.zeros((count, longest), dtype=int), np.zeros((count, longest), dtype=bool)
    for i, page in enumerate(pages):
        for j, b in enumerate(page):
            x[i, j, b.features] = 1
            y[i, j], mask[i, j] = b.label or 0, True
    one = np.eye(2)[y] * mask[:, :, None]
    moves = np.einsum("ija,ijb->ab", one[:, :-1], one[:, 1:])
    parameters = [np.zeros((len(NAMES), 2)), np.zeros((2, 2)), np.zeros(2)]
    seen = [np.full_like(p, 1e-6) for p in parameters]
    for _ in range(rounds):
        w, change, first = parameters
        node = x @ w
        forward, backward = np.zeros_like(node), np.zeros_like(node)
        forward[:, 0] = node[:, 0] + first
        for j in range(1, longest):
            step = np.logaddexp.reduce(forward[:, j - 1, :, None] + change, axis=1) + node[:, j]
            forward[:, j] = np.where(mask[:, j, None], step, forward[:, j - 1])
        for j in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(change + (node[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(mask[:, j + 1, None], step, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(
            forward[:, :-1, :, None] + change + (node + backward)[:, 1:, None, :] - total[:, None, None, None]
        ) * mask[:, 1:, None, None]
        gradients = [
            np.einsum("ijf,ija->fa", x, one - single) / count - decay * w / 10,
            (moves - pair.sum(axis=(0, 1))) / count - decay * change / 10,
            (one - single)[:, 0].sum(axis=0) / count - decay * first / 10,
        ]
        for p, s, g in zip(parameters, seen, gradients, strict=True):
            s += g**2
            p += rate * g / np.sqrt(s)
    return Field(*parameters)


# Layouts of labelled pages. {s} is a sentence, {l} a long paragraph, {w} a few words,
# {a} a link of a few words; data-y is the label of what stands in the element.
_MAIN = [
    "<article data-y=1{c}>{inner}</article>", "<main data-y=1>{inner}</main>", "<div class='content' data-y=1>{inner}</div>",
    "<div id=main-content data-y=1>{inner}</div>", "<div class='post-body entry-content' data-y=1>{inner}</div>",
    "<section class=story data-y=1>{inner}</section>", "<div role=main data-y=1>{inner}</div>",
    "<table><tr><td data-y=1>{inner}</td></tr></table>", "<div data-y=1>{inner}</div>", "<main><article data-y=1>{inner}</article></main>",
]
_INNER = [
    "<h1>{w}</h1>", "<h2>{w}</h2>", "<p>{l}</p>", "<p>{l}</p>", "<p>{l}</p>", "<p>{s}</p>", "<p>{w}.</p>", "<p>{s} {a} {s}</p>",
    "<ul><li>{s}</li><li>{w}</li></ul>", "<ol><li>{a}</li><li>{s}</li></ol>", "<blockquote>{s}</blockquote>", "<pre>{s}</pre>",
    "<table><tr><th>{w}</th><td>{w}</td></tr></table>", "<figure><img><figcaption>{s}</figcaption></figure>", "<p><b>{w}<br><p>{l}</p>",
    "<div>{l}</div>", "<h3>{w}</h3>", "<p>{w} | {w}</p>", "<p>Licensed under {w}.</p>", "<p>Copyright (c) 2019 {w}. {s}</p>", "<p>&copy; {w}</p>", "{l}<br><br>{s}", "<header><h1>{w}</h1></header>",
]
_SHORT = ["<p>{l}</p>", "<p>{l}</p>", "<p>{s}</p>", "<p>{s} {s}</p>", "<p>{s} {a} {s}</p>", "<div>{l}</div>", "<p>{w}.</p>"]
_BARE = ["<div data-y=1>{inner}</div>", "<section data-y=1>{inner}</section>", "<article data-y=1>{inner}</article>", "<body data-y=1>{inner}"]
_WITHIN = [
    "<div class='ad' data-y=0>{s}</div>", "<aside class=related data-y=0><h3>{w}</h3><ul><li>{a}</li><li>{a}</li></ul></aside>",
    "<div class='share social' data-y=0>{a} {a}</div>", "<div class=newsletter data-y=0><p>{s}</p><form><label>{w}</label><button>{w}</button></form></div>",
    "<form data-y=0><p>{s}</p><input><button>{w}</button></form>", "<nav data-y=0>{a} {a} {a}</nav>", "<aside data-y=0><p>{l}</p></aside>",
    "<div class=advertisement data-y=0><p>{s}</p></div>", "<section class='comments' data-y=0><h3>{w}</h3><p>{s}</p><p>{l}</p></section>",
    "<div class=notice data-y=0>{s}</div>", "<footer data-y=0>{s}</footer>",
]
_BEFORE = [
    "<nav data-y=0><ul><li>{a}</li><li>{a}</li><li>{a}</li><li>{a}</li></ul></nav>", "<header data-y=0><h1>{w}</h1><p>{s}</p></header>",
    "<div class='header' data-y=0><a href=/>{w}</a><div>{w}</div></div>", "<div class='menu' data-y=0>{a} | {a} | {a}</div>",
    "<div id=cookie-notice data-y=0><p>{s} {s}</p><button>{w}</button></div>", "<div class='ad' data-y=0>{s}</div>", "<div class='banner' data-y=0><p>{l}</p></div>",
    "<div class='breadcrumb' data-y=0>{a} &gt; {a} &gt; {w}</div>", "<div role=navigation data-y=0>{a} {a}</div>", "<form class=search data-y=0><label>{w}</label><input></form>",
    "<ul data-y=0><li>{a}</li><li>{a}</li><li>{a}</li></ul>", "<div class='alert' role=alert data-y=0>{s}</div>", "<aside class=sidebar data-y=0><h3>{w}</h3><p>{l}</p>{a}</aside>",
]
_AFTER = [
    "<footer data-y=0>&copy; {w} &middot; {s} {s}</footer>", "<footer data-y=0><p>{l}</p><ul><li>{a}</li><li>{a}</li></ul></footer>",
    "<div id=footer data-y=0><p>Copyright {w}</p><p>{s}</p></div>", "<div id='sidebar' data-y=0><h4>{w}</h4><p>{s}</p><ul><li>{a}</li></ul></div>",
    "<aside data-y=0><h3>{w}</h3><p>{l}</p></aside>", "<section id=comments class='comments' data-y=0><h2>{w}</h2><div class=comment><b>{w}</b><p>{l}</p></div><div class=comment><p>{s}</p></div></section>",
    "<ol class='commentlist' data-y=0><li>{l}</li><li>{s}</li></ol>", "<div class='comments' data-y=0><article class=comment><p>{l}</p></article><form><label>{w}</label><button>{w}</button></form></div>",
    "<div class='widget' data-y=0><p>{l}</p></div>", "<div class='related-posts' data-y=0>{a}<p>{s}</p>{a}</div>", "<div class='ads' data-y=0><p>{l}</p></div>",
    "<div data-y=0>&copy; {w}. {s}</div>", "<p data-y=0>&copy; 2021 {w}</p>", "<div role=contentinfo data-y=0><p>{s}</p></div>", "<div class=disclaimer data-y=0>{s}</div>",
    "<form data-y=0><p>{s}</p><label>{w}</label><button>{w}</button></form>", "<div class='sponsored' data-y=0><h3>{w}</h3><p>{s}</p></div>", "<div class=subscribe data-y=0><p>{s}</p></div>",
]


def labelled_pages(count: int = 800, seed: int = 11) -> list[str]:
    """Pages of random layouts with data-y labels; words are made up, so that only form can be learned."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices("abdeilnorstu", k=rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def fill(layout: str) -> str:
        made = {
            "s": lambda: words(6, 18).capitalize() + ".",
            "l": lambda: " ".join(words(6, 18).capitalize() + "." for _ in range(rng.randint(2, 6))),
            "w": lambda: words(1, 5).capitalize(),
            "a": lambda: f"<a href=/x>{words(1, 3).capitalize()}</a>",
        }
        return re.sub(r"\{([slwa])\}", lambda m: made[m[1]](), layout)

    pages = []
    for number in range(count):
        # every other page is short: a few paragraphs, little or nothing around them
        short = number % 2 == 1
        inner = [rng.choice(_SHORT if short else _INNER) for _ in range(rng.randint(1, 3 if short else 9))]
        if rng.random() < (0.2 if short else 0.6):
            inner.insert(0, "<h1>{w}</h1>")
        if not short and rng.random() < 0.35:
            inner.insert(rng.randint(0, len(inner)), rng.choice(_WITHIN))
        most = rng.choice((0, 1, 2)) if short else 4
        before = rng.sample(_BEFORE, rng.randint(0, most))
        after = rng.sample(_AFTER, rng.randint(0, most))
        frame = rng.choice([*_MAIN, *_BARE] if short else _MAIN).replace("{c}", rng.choice(["", " class=post"])).replace("{inner}", "".join(inner))
        pages.append(fill("<html><head><title>{w}</title></head><body>" + "".join([*before, frame, *after]) + "</body></html>"))
    return pages


@cache
def default_field() -> Field:
    return fit([blocks(p) for p in labelled_pages()])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, label in zip(found, field.viterbi(found), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None, html: str = "html") -> DataFrame:
    """pages with text (empty if there is none) and n_chars, its code points; columns of these names
    are replaced and html is left out. A null html is empty. Rows are read one by one, so repeated rows
    and null ids get what their html gives."""
    ship(pages.sparkSession)
    field = field or default_field()
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in kept])
    schema = schema.add("text", T.StringType()).add("n_chars", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py(), field) for value in batch.column(len(kept))]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            names = [*kept, "text", "n_chars"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), sizes], names=names)

    return pages.select(*kept, html).mapInArrow(run, schema)
