"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read into its leaf blocks, each a run of text without block elements in it. A block's features are the tags and the words of
the class, id and role attributes of its ancestors, and facts of its text; the field labels the row of blocks as
main text or not, with learned transitions, and Viterbi decoding picks the best row of labels. Training pages come
labelled: ``labelled_pages`` makes them from layouts with known main parts.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = set("script style noscript template head title iframe object svg math canvas audio video select textarea".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
#: A new element of the key ends an open one of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
NO_PARAGRAPH = BLOCKS - {"caption", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "body", "html", "head", "title"}
BARRIER = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")
_WHITE = re.compile(r"[\t\n\f\r ]+")
_NAMED = ("class", "id", "role")
SECTIONS = set("article main section nav aside header footer form dialog details menu fieldset search".split())


class _Reader:
    """Reads a page from front to back, with a stack of open elements as browsers keep it (in the main points)."""

    def __init__(self):
        self.open: list[tuple[str, frozenset]] = []  # tag, features of the element and its ancestors
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, frozenset, int]] = []
        self.silent = 0

    def end_block(self):
        if self.parts:
            text = _WHITE.sub(" ", entities.unescape("".join(self.parts)))
            text = " ".join(text.split())
            if text:
                self.blocks.append((text, self.open[-1][1] if self.open else frozenset(), self.linked))
            self.parts, self.linked = [], 0

    def text(self, piece: str):
        if piece and not self.silent:
            self.parts.append(piece)
            if any(tag == "a" for tag, _ in self.open[-4:]):
                self.linked += len(piece)

    def pop_to(self, at: int):
        for tag, _ in self.open[at:]:
            self.silent -= tag in SILENT
        if any(tag in BLOCKS for tag, _ in self.open[at:]):
            self.end_block()
        del self.open[at:]

    def start(self, tag: str, rest: str):
        if tag in NO_PARAGRAPH:
            self.close("p", {"table", "button", "object"})
        if tag in CLOSES:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in CLOSES[tag]:
                    self.pop_to(at)
                    if tag not in ("tr", "tbody", "thead", "tfoot"):
                        break
                elif self.open[at][0] in BARRIER[tag]:
                    break
        if tag in BLOCKS or tag in ("hr",):
            self.end_block()
        if tag == "br":
            self.text("\n")
        if tag in VOID or rest.rstrip().endswith("/") and tag in ("svg", "path"):
            return
        above = self.open[-1][1] if self.open else frozenset()
        own = {f"<{tag}>"}
        if tag in SECTIONS:
            own.add(f"in<{tag}>")
        if "=" in rest:
            for name, a, b, c in _ATTRIBUTE.findall(rest):
                if name.lower() in _NAMED:
                    found = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
                    own.update(f".{w}" for w in found)
                    own.update(f"in.{w}" for w in found)
        elif "hidden" in rest.split():
            own.add(".hidden")
        if any(f.startswith("in") for f in own):  # the innermost named or sectioning element
            above = frozenset(f for f in above if not f.startswith("in"))
        self.open.append((tag, above | own))
        self.silent += tag in SILENT

    def close(self, tag: str, barrier=()):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.pop_to(at)
                return
            if self.open[at][0] in barrier:
                return


def leaf_blocks(page: str) -> list[tuple[str, frozenset, int]]:
    """(text, ancestor features, characters inside links) of each leaf block that has text, in page order.

    Character references are decoded, white space becomes one space, ends are trimmed. Elements left open and end tags without a start do no harm.
    """
    reader, at = _Reader(), 0
    for kind, begin, end, match in iter_tokens(page):
        if begin > at:
            reader.text(page[at:begin])
        at = end
        if kind == "tag":
            tag = match[2].lower()
            if match[1]:
                if tag == "p" and all(t != "p" for t, _ in reader.open):
                    reader.end_block()
                elif tag == "br":
                    reader.text("\n")
                else:
                    reader.close(tag)
            else:
                reader.start(tag, match[3] or "")
    if at < len(page):
        reader.text(page[at:])
    reader.pop_to(0)
    reader.end_block()
    return reader.blocks


def iter_tokens(page: str):
    """Tags, and stretches to skip (comments, declarations, content of raw elements), from front to back."""
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            return
        at = m.end()
        if m[2] is None:
            yield "skip", m.start(), m.end(), m
            continue
        yield "tag", m.start(), m.end(), m
        tag = m[2].lower()
        if not m[1] and tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            to = end.start() if end else len(page)
            yield "skip", at, to, m
            at = to


def features(blocks: list[tuple[str, frozenset, int]]) -> list[set[str]]:
    """Names of the features that each block has."""
    out = []
    for text, above, linked in blocks:
        own = set(above)
        n, words = len(text), text.count(" ") + 1
        own.add(f"words{min(7, words.bit_length())}")
        share = linked / max(1, n)
        own.add("linked0" if share == 0 else "linked1" if share < 0.3 else "linked2" if share < 0.8 else "linked3")
        own.add("stop" if text[-1] in ".!?…\"”»" else "nostop")
        if sum(text.count(c) for c in ",.;") * 12 >= words:
            own.add("marks")
        if text[0] == "©" or "©" in text[:40] or "copyright" in text[:80].lower():
            own.add("copyright")
        if "|" in text or "»" in text[:3] or "·" in text:
            own.add("bars")
        out.append(own)
    for k, own in enumerate(out):  # what stands before and after
        if k == 0:
            own.add("first")
        if k == len(out) - 1:
            own.add("last")
    return out


class Field:
    """A linear chain over two labels: 0 other, 1 main text."""

    def __init__(self, names: list[str], weights: np.ndarray, moves: np.ndarray, begin: np.ndarray):
        self.number = {f: n for n, f in enumerate(names)}
        self.weights, self.moves, self.begin = weights, moves, begin

    def emissions(self, rows: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(rows), 2))
        for k, own in enumerate(rows):
            known = [self.number[f] for f in own if f in self.number]
            out[k] = self.weights[known].sum(axis=0)
        return out

    def decode(self, rows: list[set[str]]) -> list[int]:
        """The best row of labels (Viterbi)."""
        e = self.emissions(rows)
        (a0, a1), steps = e[0] + self.begin, []
        (m00, m01), (m10, m11) = self.moves.tolist()
        for e0, e1 in e[1:].tolist():
            from0, from1 = a1 + m10 > a0 + m00, a1 + m11 > a0 + m01
            steps.append((from0, from1))
            a0, a1 = (a1 + m10 if from0 else a0 + m00) + e0, (a1 + m11 if from1 else a0 + m01) + e1
        label = int(a1 > a0)
        out = [label]
        for step in reversed(steps):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[set[str]], list[int]]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Fit by gradient ascent (with per-weight steps) on the conditional likelihood of whole rows of labels, by forward-backward.

    All pages go through a step together, shorter ones padded.
    """
    pages = [page for page in pages if page[0]]
    names = sorted({f for rows, _ in pages for own in rows for f in own})
    number = {f: n for n, f in enumerate(names)}
    many, longest = len(pages), max(len(rows) for rows, _ in pages)
    blocks = [(p * longest + k, number[f]) for p, (rows, _) in enumerate(pages) for k, own in enumerate(rows) for f in own]
    cell, feature = np.array(blocks).T
    y = np.full((many, longest), -1)
    for p, (_, labels) in enumerate(pages):
        y[p, : len(labels)] = labels
    live = y >= 0
    w, moves, begin = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    past = [np.full_like(x, 1e-6) for x in (w, moves, begin)]
    truth = np.stack([y == 0, y == 1], axis=2).astype(float)
    seen_moves = np.array([[(live[:, 1:] & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    for _ in range(rounds):
        e = np.stack([np.bincount(cell, w[feature, j], many * longest) for j in (0, 1)], axis=1).reshape(many, longest, 2)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + begin
        for k in range(1, longest):
            step = np.logaddexp(a[:, k - 1, :1] + moves[0], a[:, k - 1, 1:] + moves[1]) + e[:, k]
            a[:, k] = np.where(live[:, k, None], step, a[:, k - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])[:, None]
        for k in range(longest - 2, -1, -1):
            follow = e[:, k + 1] + b[:, k + 1]
            b[:, k] = np.where(live[:, k + 1, None], np.logaddexp(moves[:, 0] + follow[:, :1], moves[:, 1] + follow[:, 1:]), 0.0)
        diff = (truth - np.exp(np.minimum(a + b - z[:, :, None], 0.0))) * live[:, :, None]
        rows = diff.reshape(-1, 2)
        gw = np.stack([np.bincount(feature, rows[cell, j], len(names)) for j in (0, 1)], axis=1) - decay * many * w
        pair = a[:, :-1, :, None] + moves + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, :, None, None]
        gm = seen_moves - np.where(live[:, 1:, None, None], np.exp(np.minimum(pair, 0.0)), 0.0).sum(axis=(0, 1))
        for x, g, p in zip((w, moves, begin), (gw, gm, diff[:, 0].sum(axis=0)), past):
            p += g * g
            x += rate * g / np.sqrt(p)
    return Field(names, w, moves, begin)


#: Words of class, id and role attributes for main parts, for the rest of a page, and for inner wrappers. Fixed values.
MAIN_NAMES = "content main article post entry story body text articlebody post-content entry-content article-body story-body main-content page-content blog-post".split()
OTHER_NAMES = {
    "menu": "nav navbar menu navigation topnav breadcrumb breadcrumbs main-menu tabs toc pager pagination".split(),
    "header": "header masthead site-header top banner branding logo page-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon page-footer".split(),
    "sidebar": "sidebar side-bar aside widget related related-posts recommended recommendations popular trending tags archive categories share social more-stories".split(),
    "notice": "cookie cookie-banner consent notice alert gdpr popup modal overlay notification message subscribe-notice warning privacy".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsense ad-container".split(),
    "form": "form search login newsletter signup subscribe contact subscription search-form".split(),
    "comments": "comments comment comment-list reply replies discussion responses disqus comment-body reader-comments user-comments".split(),
}
LAYOUT_NAMES = "wrapper container row col page site inner outer section block box grid left right clearfix layout".split()


def labelled_pages(sentences: list[str], count: int = 500, seed: int = 11) -> list[tuple[list[set[str]], list[int]]]:
    """Blocks' features and labels of pages of varied layout, filled with the given sentences.

    The main part and everything around it are drawn from the element and attribute names pages use for them; the text in both is of
    one kind, and sentences outside the main part can be as long, so that the place in the tree has to decide where it can.
    """
    rng = random.Random(seed)
    pages = []

    def said(lo, hi):
        return " ".join(rng.choice(sentences) for _ in range(rng.randint(lo, hi)))

    def words(lo, hi):
        return " ".join(said(1, 1).split()[: rng.randint(lo, hi)])

    def named(names, chance=0.8):
        return f' {rng.choice(("class", "class", "class", "id"))}="{rng.choice(names)}"' if rng.random() < chance else ""

    def filler(kind):
        names = OTHER_NAMES[kind]
        if kind == "menu":
            items = "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8)))
            return rng.choice([f"<nav><ul>{items}</ul></nav>", f"<nav{named(names)}><ul>{items}</ul></nav>", f'<div class="{rng.choice(names)}"><ul>{items}</ul></div>', f'<ul class="{rng.choice(names)}">{items}</ul>', f'<div role="navigation">{items}</div>'])
        body = {
            "header": lambda: f"<h1>{words(1, 5)}</h1><p>{words(2, 8)}</p>" if rng.random() < 0.5 else f'<div><a href="/">{words(1, 3)}</a></div><span>{words(2, 9)}</span>',
            "footer": lambda: f"&copy; {words(1, 4)} &middot; {said(1, 2)}" if rng.random() < 0.6 else f"<p>{said(1, 2)}</p><p><a href='#'>{words(1, 3)}</a></p>",
            "sidebar": lambda: f"<h3>{words(1, 4)}</h3><ul>" + "".join(f'<li><a href="#">{words(2, 9)}</a></li>' for _ in range(rng.randint(2, 6))) + "</ul>" if rng.random() < 0.5 else f"<h3>{words(1, 4)}</h3><p>{said(1, 3)}</p>",
            "notice": lambda: f"<p>{said(1, 2)}</p><button>{words(1, 2)}</button>" if rng.random() < 0.6 else said(1, 2),
            "ad": lambda: said(1, 2) if rng.random() < 0.6 else f'<p>{said(1, 2)}</p><a href="#">{words(1, 4)}</a>',
            "form": lambda: f"<form><label>{words(1, 4)}</label><input type=text><p>{said(1, 1)}</p><button>{words(1, 2)}</button></form>",
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(f'<div{named(["comment", "comment-body", "reply"], 0.6)}><b>{words(1, 2)}</b><p>{said(1, 4)}</p></div>' for _ in range(rng.randint(1, 4))),
        }[kind]()
        tag = {"header": "header", "footer": "footer", "sidebar": "aside", "form": "div"}.get(kind, rng.choice(("div", "section")))
        if tag in ("header", "footer", "aside") and rng.random() < 0.6:
            return f"<{tag}{named(names, 0.5)}>{body}</{tag}>"
        return f'<{rng.choice(("div", "div", "section"))} {rng.choice(("class", "class", "id"))}="{rng.choice(names)}">{body}</div>' if rng.random() < 0.9 else f'<div role="{dict(ad="complementary", notice="alert", sidebar="complementary", header="banner", footer="contentinfo", form="search").get(kind, "region")}" class="{names[0]}">{body}</div>'

    for _ in range(count):
        parts = []
        for k in range(rng.randint(1, 9)):
            text = said(1, 5) if rng.random() < 0.85 else words(1, 6)
            shown = text.replace("&", "&amp;").replace("<", "&lt;")
            if k == 0 and rng.random() < 0.7 or rng.random() < 0.1:
                heading = rng.choice(("h1", "h1", "h2", "h3"))
                parts.append(f"<{heading}>{shown}</{heading}>")
            else:
                parts.append(rng.choice([f"<p>{shown}</p>"] * 6 + [f"<p>{shown}", f"<p><b>{shown}<br><p>", f"<blockquote><p>{shown}</p></blockquote>", f"<ul><li>{shown}</li></ul>", f"<div>{shown}</div>", f"<pre>{shown}</pre>", f'<p>{shown} <a href="#">{rng.choice(sentences).split()[0]}</a></p>', f"<table><tr><td>{shown}</td></tr></table>", f"<figure><figcaption>{shown}</figcaption></figure>"]))
        inner = [filler(rng.choice(("ad", "sidebar", "form", "comments", "notice"))) for _ in range(rng.choice((0, 0, 1, 2)))]
        row = [("m", p) for p in parts]
        for extra in inner:
            row.insert(rng.randint(1, len(row)), ("o", extra))
        kinds = [k for k in OTHER_NAMES if rng.random() < 0.55]
        before = [filler(k) for k in kinds if k in ("menu", "header", "notice", "ad") or k in ("form", "sidebar") and rng.random() < 0.4]
        after = [filler(k) for k in kinds if k in ("footer", "comments") or k in ("form", "sidebar", "ad") and rng.random() < 0.6]
        style = rng.random()
        opening, closing = ("<article>", "</article>") if style < 0.4 else (f"<article{named(MAIN_NAMES, 1)}>", "</article>") if style < 0.5 else ("<main>", "</main>") if style < 0.65 else ("<main><article>", "</article></main>") if style < 0.72 else (f"<div {rng.choice(('class', 'id'))}=\"{rng.choice(MAIN_NAMES)}\">", "</div>") if style < 0.88 else ('<div role="main">', "</div>") if style < 0.9 else ("", "")
        wrap = f'<div class="{rng.choice(LAYOUT_NAMES)}">' if rng.random() < 0.4 else ""
        page = [("o", "<html><head><title>x</title></head><body>" + "".join(before[:1]) + wrap + "".join(before[1:])), ("o", opening), *row, ("o", closing), ("o", "".join(after) + "</div>" * bool(wrap) + "</body></html>")]
        pages.append(page)
    return [_labelled(page) for page in pages]


#: Put before main text while a training page is made, to find it among the blocks. A code point of the private use area.
_MARK = "\ue000"


def _labelled(page: list[tuple[str, str]]) -> tuple[list[set[str]], list[int]]:
    """Features and labels of a page given as parts: ("m", main part) or ("o", anything else)."""
    marked = "".join(re.sub(r">([^<]*[^<\s][^<]*)", rf">{_MARK}\1", part) if kind == "m" else part for kind, part in page)
    blocks = leaf_blocks(marked)
    labels = [int(_MARK in text) for text, _, _ in blocks]
    return features([(text.replace(_MARK, "").strip() or ".", above, linked) for text, above, linked in blocks]), labels


def training_sentences(pages: DataFrame, html: str = "html", rows: int = 200, order: str = "url") -> list[str]:
    """Sentences from a bounded sample: the blocks of ``rows`` different pages, those first in the order of a hash of ``order``.

    The hashes are chosen first, so that whole pages leave their tasks only if they are in the sample, and repeated rows only once.
    """
    hashed = pages.where(F.col(html).isNotNull()).select(F.xxhash64(order).alias("a"), F.xxhash64(html).alias("b"), F.col(html).alias("h"))
    chosen = {tuple(r) for r in hashed.select("a", "b").distinct().orderBy("a", "b").limit(rows).collect()}
    if not chosen:
        return list(_SENTENCES)
    found = hashed.where(F.col("b").isin(sorted({b for _, b in chosen}))).dropDuplicates(["a", "b"]).collect()
    sample = sorted((r["a"], r["b"], r["h"]) for r in found if (r["a"], r["b"]) in chosen)
    texts = [t for _, _, page in sample for t, _, _ in leaf_blocks(page)]
    sentences = [s.strip() for t in texts for s in re.split(r"(?<=[.!?])\s+", t) if 0 < len(s.strip()) < 400]
    return sentences[:5000] or list(_SENTENCES)


#: What training pages are filled with when the table has no sentence.
_SENTENCES = ("A sentence of some words, said here.", "Another one follows it.", "And a third, with more to say, ends the row.")


def main_text(pages: DataFrame, field: Field, columns: list[str], html: str = "html") -> DataFrame:
    """The given columns, text (blocks labelled main, in page order, with one space between) and n_chars (its code points).

    A null or empty page, and one without a main block, has an empty text. Whole pages are read, whatever their length. One row per row,
    repeated rows included; an empty table gives none. A given column named like a result gives way to it.
    """
    columns = [c for c in columns if c not in ("text", "n_chars")]
    model = pages.sparkSession.sparkContext.broadcast((list(field.number), field.weights, field.moves, field.begin))  # a few hundred weights
    kinds = "".join(f"k{n} {pages.schema[c].dataType.simpleString()}, " for n, c in enumerate(columns))

    def extract(known: Field, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        return " ".join(b[0] for b, label in zip(blocks, known.decode(features(blocks))) if label) if blocks else ""

    def run(batches):
        known = Field(*model.value)
        for batch in batches:
            texts = [extract(known, h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{n}") for n in range(len(columns))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f"k{n}" for n in range(len(columns))), "text", "n_chars"])

    made = pages.select(*(F.col(c).alias(f"k{n}") for n, c in enumerate(columns)), F.col(html).cast("string").alias("html")).mapInArrow(run, f"{kinds}text string, n_chars bigint")
    return made.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(columns)), "text", "n_chars")
