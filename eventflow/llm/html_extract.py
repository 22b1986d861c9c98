"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A block is the text between two tags that are not inline.  Its features come from its ancestors' tags, classes and ids, and
from its text.  Weights are trained by maximum likelihood on labelled pages, and a page is decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, small_batches, text_groups

# HTML's inline, void, raw-text and self-closing-by-sibling elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select datalist button".split())
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in "script style noscript textarea title iframe".split()}  # hold text, not tags
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "body": {"head"}}
CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Parts of class names and ids that tell what an element is for.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar tabs pagination pager".split(),
    "edge": "header footer masthead banner copyright legal colophon topbar".split(),
    "side": "sidebar aside widget widgets related recommended recommendations popular trending more toc tags".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert newsletter subscribe signup".split(),
    "reader": "comment comments disqus reply replies respond responses discussion review reviews".split(),
    "share": "share sharing social follow".split(),
    "main": "article content post entry story main body text".split(),
}
KINDS = {w: k for k, words in HINTS.items() for w in words}
# a quote counts only after "=", and nothing is tried twice, so a page is read in linear time
TOKEN = re.compile(r"""<!--(?>.*?(?:-->|$))|<!\[CDATA\[(?>.*?(?:\]\]>|$))|<[!?][^>]*+(?:>|$)|"""
                   r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|$)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
PIECES = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
KEEP, DROP = 1, 0
PAGES = 400  # generated labelled pages that the field is trained on


class Block(NamedTuple):
    text: str
    leaf: str  # the innermost tag that is not inline
    inside: frozenset  # tags of ancestors, those that hold the main part left out if they tell of something else
    hints: frozenset  # what ancestors' classes, ids and roles hint at, likewise
    linked: float  # share of its characters within links


class Element:
    """An element that is not inline."""

    __slots__ = ("tag", "above", "hints", "chars", "main", "inside", "told")

    def __init__(self, tag: str, above: int, hints: frozenset) -> None:
        self.tag, self.above, self.hints = tag, above, hints
        self.chars, self.main = 0, tag in MAIN_TAGS


def hints_of(attributes: str) -> set[str]:
    """What the whole words of an element's class, id and role stand for."""
    found = set()
    for _, value in ATTRIBUTE.findall(attributes):
        found.update(KINDS[w] for w in map(str.lower, PIECES.split(value.strip("\"'"))) if w in KINDS)
        found.update(KINDS[w] for w in PIECES.split(value.strip("\"'").lower()) if w in KINDS)
    return found


OUTSIDE = frozenset(("nav", "header", "footer", "aside", "form", "dialog", "menu", "address"))
MAIN_TAGS = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body"))
WIDE, ALL = 0.5, 0.9  # shares of a page's text
MANY = 8  # elements that are not inline; a form to fill in has fewer


def settle(elements: list[Element]) -> None:
    """What each element tells about the blocks below it.

    An element that holds an article or the main part, or a heading and most of the page's text, is a wrapper: its name and its classes
    (states of the page, names of themes, a form around all) do not tell that what it holds is something else.  Nor do those of the
    page itself, of an article that has most of the text or is the only one, or of a form around the whole page.
    """
    below = [0] * len(elements)
    alone = Counter(e.tag for e in elements)
    for k in range(len(elements) - 1, -1, -1):  # children come after their parents
        e = elements[k]
        if e.above >= 0:
            elements[e.above].chars += e.chars
            below[e.above] += below[k] + 1
            if e.main or (e.tag == "h1"):
                elements[e.above].main = elements[e.above].main or e.main or None  # None: a heading only
    total = max(1, sum(e.chars for e in elements if e.above < 0))
    nothing = frozenset()
    for e, inner in zip(elements, below):
        outer = elements[e.above] if e.above >= 0 else None
        wide = e.chars >= WIDE * total
        wrapper = (e.tag in ROOTS or (e.main is True and (e.tag not in MAIN_TAGS or wide or alone[e.tag] == 1)) or (e.main is None and wide)
                   or (e.tag == "form" and e.chars >= ALL * total and inner >= MANY))
        own = nothing if wrapper and e.tag in OUTSIDE else frozenset((e.tag,))
        hints = e.hints & MAIN_HINT if wrapper else e.hints
        if outer is not None and outer.told >= hints and outer.inside >= own:
            e.inside, e.told = outer.inside, outer.told  # shared, so that deep nesting costs nothing
        else:
            e.inside, e.told = (own | outer.inside, hints | outer.told) if outer is not None else (own, hints)


MAIN_HINT = frozenset(("main",))


def blocks_of(page: str) -> list[Block]:
    """The non-empty text blocks of a page, in order; unclosed and misplaced tags do no harm."""
    found: list[tuple[str, int, float]] = []
    elements: list[Element] = [Element("", -1, frozenset())]
    stack: list[tuple[str, int]] = []  # open tags, with the innermost element that is not inline
    texts: list[str] = []
    opened = Counter()
    linked, at, raw, goes_on = [0, 0], 0, None, 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(texts)).split()) if texts else ""
        texts.clear()
        if text:
            inner = stack[-1][1] if stack else 0
            elements[inner].chars += len(text)
            found.append((text, inner, linked[0] / max(1, linked[1])))
        linked[:] = [0, 0]

    def take(text: str) -> None:
        if text and raw is None:
            texts.append(text)
            linked[1] += len(text)
            if opened["a"]:
                linked[0] += len(text)

    def pop(tag: str) -> None:
        if not opened[tag]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                if tag not in INLINE:
                    flush()
                    for other, _ in stack[k:]:
                        opened[other] -= 1
                    del stack[k:]
                else:
                    opened[tag] -= 1
                    del stack[k]
                return
            if tag in INLINE and stack[k][0] not in INLINE:
                return

    while token := TOKEN.search(page, goes_on):
        take(page[at:token.start()])
        at = goes_on = token.end()
        closing, tag, attributes = token[1], (token[2] or "").lower(), token[3] or ""
        if not tag:
            continue
        if tag in ENDS and not closing and not attributes.endswith("/"):
            end = ENDS[tag].search(page, at)
            goes_on = end.start() if end else len(page)
        if raw is not None:
            if closing and tag == raw:
                raw = None
            continue
        if closing:
            if tag not in INLINE:
                flush()
            pop(tag)
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSE_P:
                pop("p")
            for other in SIBLINGS.get(tag, ()):
                if any(t == other for t, _ in stack[-3:]) or tag == "body":
                    pop(other)
        if tag in RAW:
            if not attributes.endswith("/"):
                raw = tag
        elif tag not in VOID and not attributes.endswith("/"):
            inner = stack[-1][1] if stack else 0
            if tag not in INLINE:
                elements.append(Element(tag, inner, frozenset(hints_of(attributes)) if "=" in attributes else frozenset()))
                inner = len(elements) - 1
            stack.append((tag, inner))
            opened[tag] += 1
    take(page[at:])
    flush()
    settle(elements)
    return [Block(text, elements[e].tag, elements[e].inside, elements[e].told, share) for text, e, share in found]


STRUCTURE = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "p", "h1", "h2", "h3", "table", "td",
             "blockquote", "pre", "figure", "figcaption", "dl", "div", "body", "head", "details", "dialog", "address", "menu")
NAMES = ([f"in {t}" for t in STRUCTURE] + [f"leaf {t}" for t in STRUCTURE] + [f"hint {h}" for h in HINTS]
         + ["bias", "links", "all links", "short", "middle", "long", "stop", "copyright", "shouting", "first", "last", "boiler in main"])
INDEX = {n: i for i, n in enumerate(NAMES)}


def features_of(blocks: list[Block]) -> np.ndarray:
    """One row of features for each block."""
    x = np.zeros((len(blocks), len(NAMES)))
    for row, (b, k) in zip(x, zip(blocks, range(len(blocks)))):
        for tag in b.inside:
            if (i := INDEX.get(f"in {tag}")) is not None:
                row[i] = 1
        if (i := INDEX.get(f"leaf {b.leaf}")) is not None:
            row[i] = 1
        for hint in b.hints:
            row[INDEX[f"hint {hint}"]] = 1
        words = b.text.count(" ") + 1
        row[INDEX["bias"]] = 1
        row[INDEX["links"]] = b.linked
        row[INDEX["all links"]] = b.linked > 0.8
        row[INDEX["short"]] = words < 4
        row[INDEX["middle"]] = 4 <= words < 15
        row[INDEX["long"]] = words >= 15
        row[INDEX["stop"]] = b.text[-1] in ".!?\"”»…"
        row[INDEX["copyright"]] = "©" in b.text or "(c) " in b.text.lower()
        row[INDEX["shouting"]] = b.text.isupper()
        row[INDEX["first"]] = k == 0
        row[INDEX["last"]] = k == len(blocks) - 1
        row[INDEX["boiler in main"]] = bool(MAIN_TAGS & b.inside) and bool(OUTSIDE & b.inside or b.hints - MAIN_HINT)
    return x


class Field(NamedTuple):
    """Weights: features by label, and label after label."""

    state: np.ndarray
    step: np.ndarray

    def decode(self, x: np.ndarray) -> list[int]:
        """The likeliest labels (Viterbi); of equally likely paths the one that drops."""
        scores = x @ self.state
        best, back = scores[0], []
        for row in scores[1:]:
            ways = best[:, None] + self.step
            back.append(ways.argmax(0))
            best = ways.max(0) + row
        label = int(best.argmax())
        path = [label]
        for pointers in reversed(back):
            label = int(pointers[label])
            path.append(label)
        return path[::-1]


def train(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, rate: float = 0.1, decay: float = 0.002) -> Field:
    """Maximum likelihood by gradient steps (Adam) over all pages at once, with forward and backward sums in logarithms."""
    longest = max(len(y) for _, y in pages)
    n, d = len(pages), pages[0][0].shape[1]
    x, y, mask = np.zeros((n, longest, d)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for k, (xs, ys) in enumerate(pages):
        x[k, :len(ys)], y[k, :len(ys)], mask[k, :len(ys)] = xs, ys, True
    one = np.eye(2)
    seen_state = np.einsum("ntd,ntl->dl", x, one[y] * mask[..., None])
    pairs = mask[:, 1:]
    seen_step = np.einsum("nti,ntj->ij", one[y[:, :-1]] * pairs[..., None], one[y[:, 1:]] * pairs[..., None])
    state, step = np.zeros((d, 2)), np.zeros((2, 2))
    moments = [np.zeros_like(state), np.zeros_like(state), np.zeros_like(step), np.zeros_like(step)]
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    blocks = mask.sum()
    for t in range(1, rounds + 1):
        s = (x.reshape(-1, d) @ state).reshape(n, longest, 2)
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0]
        for k in range(1, longest):
            forward[:, k] = np.where(mask[:, k, None], lse(forward[:, k - 1, :, None] + step, 1) + s[:, k], forward[:, k - 1])
        for k in range(longest - 2, -1, -1):
            backward[:, k] = np.where(mask[:, k + 1, None], lse(step + (s[:, k + 1] + backward[:, k + 1])[:, None, :], 2), 0)
        total = lse(forward[:, -1], 1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        double = np.exp(forward[:, :-1, :, None] + step + (s[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        gradients = (np.einsum("ntd,ntl->dl", x, single) - seen_state, (double * pairs[..., None, None]).sum((0, 1)) - seen_step)
        for k, (w, g) in enumerate(zip((state, step), gradients)):
            g = g / blocks + decay * w
            m, v = moments[2 * k], moments[2 * k + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Field(state, step)


#: Classes of bodies, wrappers and articles that speak of other parts of the page.
MISLEADING = ("has-sidebar", "single comments-open", "header-fixed", "post tags-x", "with-ads", "layout widget-area", "no-menu page", "cookie-ok", "hentry category-social")


def labelled_page(rng: random.Random) -> tuple[str, set[str]]:
    """A generated page and the texts of its main blocks: an article in one of several layouts, among what is not one."""
    serial = iter(range(10_000))
    word = lambda: "".join(rng.choice("aeiourstnlm") for _ in range(rng.randint(2, 9)))
    phrase = lambda a, b: " ".join([f"{word()}{next(serial)}"] + [word() for _ in range(rng.randint(a, b))])
    sentence = lambda a, b: phrase(a, b).capitalize() + rng.choice(("", ".", ".", "!", "?"))
    link = lambda text: f'<a href="/{word()}">{text}</a>'
    kept: set[str] = set()

    def keep(text: str) -> str:
        kept.add(text)
        return text

    def listing(n: int, tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f"<li>{link(phrase(0, 3))}</li>" for _ in range(n)) + f"</{tag}>"

    def named(*names: str) -> str:
        return f'{rng.choice(("class", "id"))}="{rng.choice(names)}"'

    menu = lambda: rng.choice((f"<nav>{listing(rng.randint(2, 8))}</nav>", f"<div {named('menu', 'navbar', 'main-nav', 'breadcrumbs')}>{listing(rng.randint(2, 8))}</div>"))
    head = lambda: rng.choice((f"<header><p>{phrase(1, 6)}</p>{menu()}</header>", f"<div {named('header', 'masthead', 'site-header')}>{phrase(1, 6)}</div>", menu()))
    advert = lambda: f"<div {named('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo')}>{sentence(2, 30)}</div>"
    notice = lambda: f"<{(t := rng.choice(('div', 'section', 'dialog')))} {named('cookie-banner', 'consent', 'notice', 'newsletter', 'gdpr')}><p>{sentence(5, 30)}</p></{t}>"
    form = lambda: f"<form><label>{phrase(0, 3)}</label><input name=q><p>{sentence(2, 12)}</p></form>"
    side = lambda: rng.choice((f"<aside><h3>{phrase(0, 3)}</h3>{listing(rng.randint(2, 6))}<p>{sentence(3, 25)}</p></aside>",
                               f"<div {named('sidebar', 'related', 'widget', 'recommended')}><h3>{phrase(0, 3)}</h3><p>{sentence(3, 25)}</p></div>"))

    def readers() -> str:
        said = "".join(f"<div {named('comment', 'comment-body', 'reply')}><p>{sentence(3, 40)}</p></div>" for _ in range(rng.randint(1, 4)))
        return rng.choice((f"<section {named('comments', 'discussion', 'reader-comments')}><h2>{phrase(0, 2)}</h2>{said}</section>", f"<div {named('comments', 'responses comments', 'disqus')}>{said}</div>"))

    foot = lambda: rng.choice((f"<footer>&copy; {word()}.example &middot; {sentence(2, 25)}</footer>", f"<div {named('footer', 'site-footer', 'copyright')}><p>{sentence(2, 25)}</p></div>"))
    share = lambda: f"<div {named('share', 'social')}>{link(word())}{link(word())}</div>"

    def paragraph() -> str:
        text = keep(sentence(*rng.choice(((0, 5), (5, 20), (20, 90)))))
        shape = rng.random()
        if shape < 0.5:
            return f"<p>{text}</p>"
        if shape < 0.65:
            return f"<p>{text}"
        if shape < 0.75:
            return f"<p><b>{text}<br>"
        if shape < 0.8:
            return f"<h2>{text}</h2>"
        if shape < 0.85:
            return f"<ul><li>{text}</li><li>{keep(sentence(2, 12))}</li></ul>"
        if shape < 0.9:
            return f"<blockquote>{text}</blockquote>"
        if shape < 0.95:
            return f"<table><tr><td>{text}</td><td>{keep(phrase(0, 3))}</td></tr></table>"
        return f"<div>{text}</div>"

    inner = "".join(paragraph() for _ in range(rng.randint(1, 12)))
    title = f"<h1>{keep(phrase(1, 12))}</h1>" if rng.random() < 0.85 else ""
    inside = "".join(part() for part in (advert, share, notice, form, side) if rng.random() < 0.12)
    cut = rng.randint(0, 1)
    inner = title + (inside if cut else "") + inner + ("" if cut else inside)
    layout = rng.random()
    if layout < 0.45:
        body = f"<article>{inner}</article>"
    elif layout < 0.6:
        body = f"<main>{inner}</main>"
    elif layout < 0.7:
        body = f"<main><article>{inner}</article></main>"
    elif layout < 0.85:
        body = f"<div {named('content', 'post', 'entry-content', 'article-body', 'story')}>{inner}</div>"
    else:
        body = f"<div>{inner}</div>" if rng.random() < 0.5 else inner
    if rng.random() < 0.3:
        body = body.replace("<article>", f'<article class="{rng.choice(MISLEADING)}">', 1)
    for _ in range(rng.choice((0, 0, 1, 2)) if "<article" in body or "<main" in body else 0):
        body = f'<{(t := rng.choice(("div", "section", "main", "div")))} class="{rng.choice(MISLEADING)}">{body}</{t}>'
    parts = [head()] if rng.random() < 0.9 else []
    parts += [p() for p in (menu, notice, advert, form) if rng.random() < 0.35]
    rest = [p() for p in (side, readers, advert, share, notice, form) if rng.random() < 0.35]
    rng.shuffle(parts)
    page = "".join(parts) + body + "".join(rest) + (foot() if rng.random() < 0.9 else "")
    start = f"<!DOCTYPE html><html><head><title>{phrase(1, 8)}</title></head><body>"
    start = start.replace("<body>", f'<body class="{rng.choice(MISLEADING)}">') if rng.random() < 0.4 else start
    if rng.random() < 0.1:
        page = f"<form action=x>{page}</form>"
    return (start if rng.random() < 0.9 else "") + page + ("</body></html>" if rng.random() < 0.8 else ""), kept


def generated_field(pages: int = PAGES, seed: int = 7) -> Field:
    """A field trained on generated labelled pages."""
    rng = random.Random(seed)
    made = []
    for _ in range(pages):
        page, kept = labelled_page(rng)
        blocks = blocks_of(page)
        made.append((features_of(blocks), np.array([KEEP if b.text in kept else DROP for b in blocks])))
    return train(made)


def main_text(page: str, field: Field) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return " ".join(b.text for b, label in zip(blocks, field.decode(features_of(blocks))) if label == KEEP)


def extract(pages: DataFrame, field: Field | None = None, html: str = "html") -> DataFrame:
    """`pages` with `text`, the main text of each page, in place of the column `html`.

    Blocks that the field keeps, references decoded and white space made single blanks, are joined in order by a blank; a page
    without any, or a null page, has empty text.  `field` is trained on `PAGES` generated pages if not given (see `train` for
    one's own labelled pages).  Rows are kept as they are; a column named `text` is replaced and others pass through.
    """
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(tuple(field or generated_field()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Field(*sent.value)
        for batch in batches:
            texts = [main_text(h, weights) for group in text_groups(batch.column("html__")) for h in group]
            yield batch.drop_columns(["html__"]).append_column("text", pa.array(texts, pa.string()))

    names = [f"`{c}`" for c in pages.columns if c not in ("text", html)]
    frame = pages.select(*names, filled(html).alias("html__"))
    return frame.mapInArrow(run, pages.select(*names).withColumn("text", F.lit("")).schema)
