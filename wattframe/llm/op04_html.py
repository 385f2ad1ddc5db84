"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is cut into leaf blocks: runs of text between block-level tags. Each block has features of its ancestors (their
tags, and what their ``class`` and ``id`` words speak of) and of its text; the field labels the sequence of a page's blocks
as content or not, and Viterbi finds the best labelling. The weights come from labelled pages that :func:`labelled_page`
makes from templates of many shapes; training takes seconds, needs no table, and gives the same weights every time.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattframe.llm.texts import tidy

BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas audio video noembed noframes xmp".split())
#: What an opening tag closes, up to a holder.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDER = frozenset("ul ol dl table body div section article aside main nav header footer form td th select menu".split())

_TAG = re.compile(r"""<!--|<[!?][^>]*>|</([A-Za-z][^\s/>]*)[^>]*>|<([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<([A-Za-z][^\s/>]*)([^>]*)>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: What words of class, id and role speak of.
TOPICS = {
    "comment": "comment comments commentlist reply replies respond discussion disqus responses feedback thread",
    "advert": "ad ads adv advert advertisement adverts adsense adslot adbox adunit sponsor sponsored promo promoted promotion banner dfp outbrain taboola",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc toolbar skip topbar",
    "footer": "footer foot copyright legal colophon bottom siteinfo contentinfo",
    "header": "masthead header branding logo sitehead siteheader topline",
    "side": "sidebar side aside widget widgets rail related recommended recommendations recirc trending popular more complementary teaser teasers",
    "notice": "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog disclaimer warning message announcement toast paywall",
    "social": "share sharing social follow subscribe subscription newsletter signup login tags tagcloud meta byline",
    "form": "form search searchbox searchform contact",
    "content": "article content post entry story text main body articlebody maincontent postcontent entrycontent page prose copy",
}
_TOPIC = {w: t for t, ws in TOPICS.items() for w in ws.split()}
_ANCESTORS = ["head", "header", "nav", "footer", "aside", "form", "article", "main", "section", "ul", "ol", "li", "table", "figure", "figcaption", "blockquote", "button", "select", "dialog", "menu", "details"]
_PARENTS = ["p", "h1", "h2", "h3", "h4", "li", "div", "td", "th", "figcaption", "title", "a", "span", "pre", "dt", "dd", "blockquote", "section", "article", "body"]
FEATURES = ["one", *(f"in {t}" for t in _ANCESTORS), *(f"as {t}" for t in _PARENTS), *(f"about {t}" for t in TOPICS), "in article, no topic", "in main, no topic", "hidden", "linked", "half linked", "few words", "some words", "many words", "very many words", "sentence end", "starts with mark", "digits", "capitals", "copyright", "first", "after h1", "before h1", "deep"]
_INDEX = {f: k for k, f in enumerate(FEATURES)}


@dataclass
class Block:
    text: str
    features: list[int]


def _topics(attributes: str) -> frozenset[str]:
    found = set()
    for m in _NAMES.finditer(attributes):
        for word in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[1] or m[2] or m[3] or "").lower()):
            if word in _TOPIC:
                found.add(_TOPIC[word])
    return frozenset(found)


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page, in order, those without text left out."""
    out: list[tuple[str, int, tuple]] = []
    stack: list[tuple[str, frozenset[str], bool]] = []
    parts: list[str] = []
    linked, links = 0, 0
    lower = None

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((text, linked, tuple(stack)))
        parts, linked = [], 0

    def push_text(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            push_text(html[at:])
            break
        push_text(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            close = html.find("-->", at)
            at = n if close < 0 else close + 3
            continue
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCK:
                end_block()
            elif tag == "br":
                push_text(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCK or not any(x[0] in BLOCK for x in stack[k:]):
                        del stack[k:]
                    break
            links = sum(x[0] == "a" for x in stack)
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        attributes = m[3] if m[2] else m[5]
        if tag in RAW:
            if lower is None:
                lower = html.lower()
                if len(lower) != n:
                    lower = "".join(c.lower() if c.isascii() else c for c in html)
            if tag in BLOCK:
                end_block()
            if not attributes.endswith("/"):
                close = lower.find(f"</{tag}", at)
                close = n if close < 0 else lower.find(">", close)
                at = n if close < 0 else close + 1
                at = min(at, n)
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag in ("br", "wbr") or tag == "img":
                push_text("" if tag == "wbr" else " ")
            continue
        if tag in BLOCK:
            end_block()
            for k in range(len(stack) - 1, -1, -1):  # a paragraph ends where another block begins
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in HOLDER:
                    break
            if tag == "body" or tag not in ("title", "head", "html") and stack and any(x[0] == "head" for x in stack):
                stack = [x for x in stack if x[0] not in ("head", "title")]
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] in HOLDER and not (tag in ("td", "th", "tr") and stack[k][0] in ("td", "th")):
                        break
        if not attributes.endswith("/"):
            stack.append((tag, _topics(attributes) if attributes else frozenset(), bool(attributes and _HIDDEN.search(attributes))))
        links = sum(x[0] == "a" for x in stack)
    end_block()
    return [Block(t, f) for (t, *_), f in zip(out, _features(out))]


def _features(raw: list[tuple[str, int, tuple]]) -> list[list[int]]:
    h1 = next((k for k, (_, _, s) in enumerate(raw) if any(x[0] == "h1" for x in s)), None)
    out = []
    for k, (text, linked, stack) in enumerate(raw):
        tags = {x[0] for x in stack}
        topics = set().union(*(x[1] for x in stack)) if stack else set()
        parent = next((x[0] for x in reversed(stack) if x[0] in BLOCK), "body")
        f = ["one", *(f"in {t}" for t in _ANCESTORS if t in tags), *(f"about {t}" for t in topics)]
        if parent in _PARENTS:
            f.append(f"as {parent}")
        plain = not topics - {"content", "header"}
        if "article" in tags and plain:
            f.append("in article, no topic")
        if "main" in tags and plain:
            f.append("in main, no topic")
        if any(x[2] for x in stack):
            f.append("hidden")
        size = len(text)
        if linked > 0.8 * size:
            f.append("linked")
        elif linked > 0.3 * size:
            f.append("half linked")
        words = text.count(" ") + 1
        f.append("few words" if words < 4 else "some words" if words < 12 else "many words" if words < 40 else "very many words")
        if text[-1] in ".!?…\"'":
            f.append("sentence end")
        if not text[0].isalnum():
            f.append("starts with mark")
        if sum(c.isdigit() for c in text[:200]) > 0.2 * min(size, 200):
            f.append("digits")
        if text[:60].isupper():
            f.append("capitals")
        if "©" in text[:40] or "copyright" in text[:80].lower():
            f.append("copyright")
        if k == 0:
            f.append("first")
        if h1 is not None:
            f.append("after h1" if k >= h1 else "before h1")
        if len(stack) > 8:
            f.append("deep")
        out.append([_INDEX[x] for x in f])
    return out


def labelled_page(seed: int) -> tuple[str, list[bool]]:
    """A made-up page and, for each of its blocks in order, whether it is content."""
    rnd = random.Random(seed)
    words = lambda a, b: " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(a, b)))
    page: list[str] = []
    truth: list[bool] = []
    noise = ["", "", ' class="row"', ' class="container col-8"', ' class="wrap"', ' id="x1"', ' data-k="v"']

    def put(tag: str, text: str, content: bool, attributes: str | None = None) -> None:
        a = rnd.choice(noise) if attributes is None else attributes
        page.append(f"<{tag}{a}>{text}</{tag}>")
        truth.append(content)

    def sentence(a: int = 5, b: int = 60) -> str:
        t = words(a, b).capitalize() + rnd.choice([".", ".", ".", "?", "!", "", " |", "&amp;", "***"])
        if rnd.random() < 0.15:
            t = f'{t} <a href="#">{words(1, 3)}</a> {words(2, 9)}.'
        if rnd.random() < 0.1:
            t = f"<b>{t}"
        return t

    def names(topic: str) -> str:
        w = rnd.choice(TOPICS[topic].split())
        return rnd.choice([f' class="{w}"', f' id="{w}"', f' class="{w}-{rnd.choice(["box", "area", "list", "inner", "block"])}"', f' class="site-{w} clear"'])

    def menu(tag: str, attributes: str) -> None:
        page.append(f"<{tag}{attributes}><ul>")
        for _ in range(rnd.randint(2, 8)):
            put("li", f'<a href="/{words(1, 1)}">{words(1, 3)}</a>', False, "")
        page.append(f"</ul></{tag}>")

    def box(tag: str, attributes: str, a: int = 1, b: int = 3, kinds: str = "p p div h3 text") -> None:
        page.append(f"<{tag}{attributes}>")
        for _ in range(rnd.randint(a, b)):
            kind = rnd.choice(kinds.split())
            if kind == "text":
                page.append(sentence(3, 30))
                truth.append(False)
                page.append("<hr>")
            else:
                put(kind, sentence(2, 40), False)
        page.append(f"</{tag}>")

    def clutter() -> None:
        kind = rnd.randrange(9)
        if kind == 0:
            menu(rnd.choice(["nav", "div"]), names("menu"))
        elif kind == 1:
            box("div", names("advert"), 1, 2)
        elif kind == 2:
            box(rnd.choice(["aside", "div"]), names("side"), 1, 4, "p h3 li div")
        elif kind == 3:
            box(rnd.choice(["div", "section"]), names("notice"), 1, 2)
        elif kind == 4:
            box("div", names("social"), 1, 2)
        elif kind == 5:
            page.append(f"<form{rnd.choice(['', names('form')])}>")
            put("label", words(1, 4), False)
            put("button", words(1, 2), False)
            page.append("</form>")
        elif kind == 6:
            box("aside", rnd.choice(noise), 1, 4)
        elif kind == 7:
            menu("nav", "")
        else:
            box(rnd.choice(["section", "div"]), names("comment"), 1, 6, "p div li text")

    if rnd.random() < 0.08:  # nothing but an article
        tag, n = rnd.choice(["article", "article", "main"]), rnd.randint(1, 4)
        return f"<{tag}>" + "".join(f"<p>{words(1, rnd.choice([4, 30]))}" for _ in range(n)), [True] * n
    page.append(f'<!DOCTYPE html><html lang="xx"><head><meta charset="utf-8"><title>{words(3, 9)}</title><style>p{{margin:0}}</style></head><body>')
    truth.append(False)
    if rnd.random() < 0.8:
        if rnd.random() < 0.5:
            page.append(f"<header{rnd.choice(['', names('header')])}>")
            if rnd.random() < 0.6:
                put(rnd.choice(["div", "p", "h2"]), words(1, 5), False)
            menu("nav", "")
            page.append("</header>")
        else:
            menu("nav", rnd.choice(["", names("menu")]))
    for _ in range(rnd.choice([0, 0, 1, 1, 2])):
        clutter()
    tag, attributes = rnd.choice([("article", ""), ("article", ""), ("article", names("content")), ("main", ""), ("div", names("content")), ("section", names("content"))])
    outer = rnd.choice(["", "", "<main>", '<div class="content">', '<div class="container">', '<div id="page" class="wrapper">'])
    page.append(f"{outer}<{tag}{attributes}>")
    if rnd.random() < 0.15:
        page.append("<header>")
        put("h1", words(2, 12), True)
        page.append("</header>")
    elif rnd.random() < 0.9:
        put("h1", rnd.choice([words(2, 12), sentence(2, 10)]), True)
    for _ in range(rnd.choice([1, 2, 4, 8, 15])):
        kind = rnd.random()
        if kind < 0.68:
            put("p", sentence(rnd.choice([1, 5, 20]), 90), True)
        elif kind < 0.76:
            put(rnd.choice(["h2", "h3", "h4"]), words(1, 9), True)
        elif kind < 0.84:
            page.append("<ul>" if rnd.random() < 0.6 else "<ol>")
            for _ in range(rnd.randint(1, 5)):
                put("li", sentence(1, 20), True, "")
            page.append("</ul>")
        elif kind < 0.88:
            page.append("<blockquote>")
            put("p", sentence(), True)
            page.append("</blockquote>")
        elif kind < 0.91:
            page.append('<figure><img src="x.png">')
            put("figcaption", sentence(2, 20), True)
            page.append("</figure>")
        elif kind < 0.94:
            page.append("<table>")
            for _ in range(rnd.randint(1, 3)):
                page.append("<tr>")
                put("td", words(1, 5), True, "")
                put("td", words(1, 5), True, "")
                page.append("</tr>")
            page.append("</table>")
        elif kind < 0.96:
            put("pre", sentence(3, 20), True)
        elif kind < 0.98:
            put("div", sentence(8, 60), True)
        else:
            clutter()
    if rnd.random() < 0.15:  # the page breaks off
        if rnd.random() < 0.5:
            page.append("<p>" + words(1, 12))
            truth.append(True)
        return "".join(page), truth
    if rnd.random() < 0.25:
        box(rnd.choice(["section", "div"]), names("comment"), 1, 6, "p div li text")
    page.append(f"</{tag}>")
    if outer:
        page.append("</main>" if outer == "<main>" else "</div>")
    for _ in range(rnd.choice([0, 1, 2, 3])):
        clutter()
    if rnd.random() < 0.85:
        box("footer", "", 1, 3, "p div text") if rnd.random() < 0.7 else box("div", names("footer"), 1, 3, "p div text")
    page.append("</body></html>")
    return "".join(page), truth


@dataclass
class Field:
    """Weights of the two labels: of features, of following one another, and of beginning."""

    state: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    def decode(self, features: list[list[int]]) -> list[bool]:
        """Viterbi."""
        if not features:
            return []
        (w0, w1), (s00, s01), (s10, s11) = self._lists, self._steps[0], self._steps[1]
        back: list[tuple[bool, bool]] = []
        a0 = a1 = 0.0
        for k, f in enumerate(features):
            e0, e1 = sum([w0[x] for x in f]), sum([w1[x] for x in f])
            if k:
                back.append((a1 + s10 > a0 + s00, a1 + s11 > a0 + s01))
                a0, a1 = max(a0 + s00, a1 + s10) + e0, max(a0 + s01, a1 + s11) + e1
            else:
                a0, a1 = float(self.begin[0]) + e0, float(self.begin[1]) + e1
        label = a1 > a0
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def __post_init__(self):
        self._lists, self._steps = self.state.tolist(), self.step.tolist()


def _smooth(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


@lru_cache(1)
def trained(pages: int = 400, rounds: int = 200) -> Field:
    """The field fitted to made-up pages: conditional likelihood by forward and backward sums over all pages at once."""
    sequences = []
    for seed in range(pages):
        html, truth = labelled_page(seed)
        found = blocks(html)
        if len(found) != len(truth):
            raise AssertionError(f"page {seed}: {len(found)} blocks, {len(truth)} labels")
        sequences.append((found, truth))
    longest = max(len(t) for _, t in sequences)
    x = np.zeros((pages, longest, len(FEATURES)), np.float32)
    y = np.zeros((pages, longest), int)
    size = np.array([len(t) for _, t in sequences])
    for p, (found, truth) in enumerate(sequences):
        for t, b in enumerate(found):
            x[p, t, b.features] = 1
        y[p, : len(truth)] = truth
    live = np.arange(longest) < size[:, None]
    state, step, begin = np.zeros((2, len(FEATURES))), np.zeros((2, 2)), np.zeros(2)
    hot = np.eye(2)[y] * live[..., None]
    moves = live[:, 1:]
    seen = [np.einsum("ptl,ptf->lf", hot, x), np.einsum("pti,ptj->ij", hot[:, :-1], hot[:, 1:]), hot[:, 0].sum(0)]
    moment = [[np.zeros_like(v), np.zeros_like(v)] for v in (state, step, begin)]
    for k in range(1, rounds + 1):
        e = x @ state.T.astype(np.float32) + 0.0
        forward, backward = np.zeros((pages, longest, 2)), np.zeros((pages, longest, 2))
        forward[:, 0] = begin + e[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.where(live[:, t, None], _smooth(forward[:, t - 1, :, None] + step, 1) + e[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            backward[:, t] = np.where(live[:, t + 1, None], _smooth(step + (e[:, t + 1] + backward[:, t + 1])[:, None], 2), 0)
        z = _smooth(forward[:, -1], 1)
        p = np.exp(forward + backward - z[:, None, None]) * live[..., None]
        pair = np.exp(forward[:, :-1, :, None] + step + (e[:, 1:] + backward[:, 1:])[:, :, None] - z[:, None, None, None]) * moves[..., None, None]
        expected = [np.einsum("ptl,ptf->lf", p, x), pair.sum((0, 1)), p[:, 0].sum(0)]
        for v, s, m, (a, b) in zip((state, step, begin), seen, expected, moment):
            g = (s - m) / pages - 1e-3 * v
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v += 0.1 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return Field(state, step, begin)


def main_text(html: str | None, field: Field) -> str:
    if not html:
        return ""
    found = blocks(html)
    return "\n".join(b.text for b, keep in zip(found, field.decode([b.features for b in found])) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    A null or empty page has an empty text, as has one without content; broken markup is read as far as it goes (an
    open comment, script or tag swallows the rest, as in browsers); nothing is cut short. Repeated rows have equal
    texts. Other columns are not read. An empty table gives an empty result.
    """
    field = trained()

    def read(batches):
        for batch in batches:
            texts = [main_text(h, field) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tidy(read), "page_id long, url string, text string, n_chars long")
