"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: the text between two borders of block-level
elements, each with its ancestors' tags and the kinds of words in their class,
id and role.  The field labels the sequence of blocks as text or boilerplate
from features of ancestors and text and from neighbouring labels; Viterbi search
finds the best sequence.

It is trained on labelled pages: at most ``SAMPLE_PAGES`` pages of the input that
mark their article up, labelled by that mark, and as many pages composed from
their texts with other layouts (sidebars, notices, forms, comments, articles in
plain divisions), whose labels are known.
"""

from __future__ import annotations

import html
import pickle
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords as bw
from .common import smallest, table

#: Most pages that the field is trained on.
SAMPLE_PAGES = 300
#: Characters, and blocks, of a page up to which it may be trained on; all pages are extracted whole.
SAMPLE_CHARS, SAMPLE_BLOCKS = 40_000, 80
#: Blocks of a page, each of fewer than so many characters, that composed pages are made from.
COMPOSED_BLOCKS, COMPOSED_CHARS = 40, 3_000

#: A quote opens a value only right after an equals sign; one that is never closed is a character like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WHITE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+")

# Kinds of elements.
_RAW = frozenset("script style noscript template textarea title iframe svg math object select button canvas video audio".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSED_BY_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words of class, id and role by what they name.
KINDS = {
    "advert": "ad ads adv advert advertisement advertising banner promo promotion promoted sponsor sponsored sponsors adsense dfp teaser".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip".split(),
    "side": "aside sidebar side widget widgets related recommended recommendations rail trending popular more tags complementary".split(),
    "foot": "footer foot colophon copyright legal contentinfo bottom".split(),
    "head": "header masthead topbar branding logo top site".split(),
    "comment": "comment comments reply replies respond discussion disqus feedback commentlist reader".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe subscription paywall warning message dialog toast".split(),
    "form": "form search login signup signin register contact".split(),
    "share": "share sharing social follow likes author byline meta".split(),
    "main": "article content main post entry story body text single prose page".split(),
    "hidden": "hidden invisible none sr".split(),
}
_KIND = {w: k for k, ws in KINDS.items() for w in ws}
_TAGS = "article main section div nav aside header footer form ul ol li table td p h1 h2 h3 h4 blockquote pre figure figcaption dl a fieldset address details".split()

FEATURES = ["bias", *[f"in {t}" for t in _TAGS], *[f"is {t}" for t in _TAGS], *[f"kind {k}" for k in KINDS], *[f"near {k}" for k in KINDS]]
FEATURES += [f"words {k}" for k in ("1", "2-4", "5-11", "12-29", "30+")] + [f"links {k}" for k in ("none", "some", "most")]
FEATURES += ["ends a sentence", "has a comma", "starts with ©", "has |", "first", "last", "after the longest", "article here", "outside article", "in side part of article"]
_AT = {f: k for k, f in enumerate(FEATURES)}


@dataclass
class Block:
    """A leaf block: its text, the tags around it from outside in, what their attributes name, and how much of it is links."""

    text: str
    tags: tuple[str, ...]
    kinds: tuple[frozenset[str], ...]
    linked: int


def blocks_of(page: str | None) -> list[Block]:
    """The page's leaf blocks with text, in order. Reads any text as far as it goes; unclosed elements end with those around them."""
    page = page or ""
    tags: list[str] = ["body"]
    kinds: list[frozenset[str]] = [frozenset()]
    out: list[Block] = []
    parts: list[str] = []
    links = [0, 0]  # open links, characters in links
    frame = (tuple(tags), tuple(kinds))

    def end() -> None:
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, *frame, min(links[1], len(text))))
            parts.clear()
        links[1] = 0

    def pop(n: int) -> None:
        del tags[n:], kinds[n:]

    def add(text: str) -> None:
        nonlocal frame
        if not parts:
            k = len(tags)
            while k > 1 and tags[k - 1] in _INLINE:
                k -= 1
            frame = (tuple(tags[:k]), tuple(kinds[:k]))
        parts.append(text)
        if links[0]:
            links[1] += len(text.strip())

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            add(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in _INLINE:
                end()
            if tag == "a":
                links[0] = 0
            if tag in tags[1:]:
                n = len(tags) - 1 - tags[::-1].index(tag)
                if tag not in _INLINE or not any(t not in _INLINE for t in tags[n:]):
                    pop(n)
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else (len(page) if tag in ("script", "style", "title", "textarea") else at)
            end()
            continue
        if tag in _VOID:
            if tag in ("br", "wbr", "img"):
                if tag == "br" and parts:
                    parts.append(" ")
            else:
                end()
            continue
        if tag not in _INLINE:
            end()
            if tag in _CLOSED_BY_OWN:
                for n in range(len(tags) - 1, 0, -1):
                    if tags[n] == tag or (tag in ("td", "th") and tags[n] in ("td", "th")) or (tag in ("dt", "dd") and tags[n] in ("dt", "dd")):
                        pop(n)
                        break
                    if tags[n] in _CLOSED_BY_OWN[tag]:
                        break
            elif "p" in tags[1:] and tag not in ("td", "th"):
                n = len(tags) - 1 - tags[::-1].index("p")
                if not any(t not in _INLINE for t in tags[n + 1 :]):
                    pop(n)
        if tag == "a":
            links[0] = 1
        if not m[3].endswith("/") or tag not in _INLINE:
            names = {a[0].lower(): (a[1] or a[2] or a[3]).lower() for a in _ATTRIBUTE.findall(m[3])}
            found = {_KIND[w] for key in ("class", "id", "role", "aria-label", "itemprop") for w in _SPLIT.split(names.get(key, "")) if w in _KIND}
            if "display:none" in names.get("style", "").replace(" ", "") or names.get("aria-hidden") == "true":
                found.add("hidden")
            tags.append(tag)
            kinds.append(frozenset(found))
    end()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row of 0/1 features for each block."""
    x = np.zeros((len(blocks), len(FEATURES)))
    if not blocks:
        return x
    article = any("article" in b.tags or "main" in b.tags for b in blocks)
    longest = max(range(len(blocks)), key=lambda k: len(blocks[k].text))
    for k, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        on = ["bias", f"words {'1' if n == 1 else '2-4' if n < 5 else '5-11' if n < 12 else '12-29' if n < 30 else '30+'}"]
        on += [f"in {t}" for t in set(b.tags)] + [f"is {b.tags[-1]}"]
        on += [f"kind {c}" for ks in b.kinds for c in ks] + [f"near {c}" for c in b.kinds[-1]]
        share = b.linked / len(b.text)
        on.append(f"links {'none' if not share else 'some' if share < 0.5 else 'most'}")
        on += [f for f, is_so in (
            ("ends a sentence", b.text[-1] in ".!?…\"”»"), ("has a comma", "," in b.text), ("starts with ©", b.text[0] == "©"), ("has |", "|" in b.text), ("first", k == 0),
            ("last", k == len(blocks) - 1), ("after the longest", k > longest), ("article here", article), ("outside article", article and not {"article", "main"} & set(b.tags)),
        ) if is_so]
        inner = max((j for j, t in enumerate(b.tags) if t in ("article", "main")), default=None)
        if inner is not None and (any(ks & {"advert", "comment", "notice", "form", "side", "menu"} for ks in b.kinds[inner + 1 :]) or {"aside", "form", "nav"} & set(b.tags[inner + 1 :])):
            on.append("in side part of article")
        for f in on:
            if f in _AT:
                x[k, _AT[f]] = 1.0
    return x


@dataclass
class Field:
    """Weights of features for each label (0 boilerplate, 1 text), of label pairs and of first labels."""

    weights: np.ndarray
    pairs: np.ndarray
    first: np.ndarray

    def labels(self, x: np.ndarray) -> list[int]:
        """The best labels of a page's blocks, by Viterbi search."""
        if not len(x):
            return []
        own = (x @ self.weights).tolist()
        (aa, ab), (ba, bb) = self.pairs.tolist()
        a, b = (o + f for o, f in zip(own[0], self.first.tolist()))
        back = []
        for p, q in own[1:]:
            fa, fb = a + aa, b + ba
            ga, gb = a + ab, b + bb
            back.append((int(fb > fa), int(gb > ga)))
            a, b = max(fa, fb) + p, max(ga, gb) + q
        out = [int(b > a)]
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return out[::-1]


def train_field(pages: list[tuple[np.ndarray, list[int]]], rounds: int = 200, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Maximises the regularised log likelihood by adaptive gradient steps over all pages at once."""
    pages = [(x, y) for x, y in pages if len(x)]
    k, n = len(FEATURES), max((len(x) for x, _ in pages), default=0)
    field = Field(np.zeros((k, 2)), np.zeros((2, 2)), np.zeros(2))
    if not pages:
        return field
    x = np.zeros((len(pages), n, k))
    y = np.zeros((len(pages), n), int)
    there = np.zeros((len(pages), n), bool)
    for i, (a, b) in enumerate(pages):
        x[i, : len(a)], y[i, : len(b)], there[i, : len(a)] = a, b, True
    one = np.eye(2)[y] * there[..., None]
    both = there[:, 1:, None, None] & there[:, :-1, None, None]
    seen_pairs = (one[:, :-1, :, None] * one[:, 1:, None, :] * both).sum((0, 1))
    steps = [np.zeros_like(v) + 1e-8 for v in (field.weights, field.pairs, field.first)]
    for _ in range(rounds):
        own = (x @ field.weights) * there[..., None]
        ahead, behind = np.zeros_like(own), np.zeros_like(own)
        ahead[:, 0] = own[:, 0] + field.first
        for t in range(1, n):
            new = np.logaddexp(ahead[:, t - 1, 0, None] + field.pairs[0], ahead[:, t - 1, 1, None] + field.pairs[1]) + own[:, t]
            ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for t in range(n - 2, -1, -1):
            later = behind[:, t + 1] + own[:, t + 1]
            new = np.logaddexp(field.pairs[:, 0] + later[:, 0, None], field.pairs[:, 1] + later[:, 1, None])
            behind[:, t] = np.where(there[:, t + 1, None], new, 0.0)
        p = np.exp(ahead + behind - total[:, None, None]) * there[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + field.pairs + (own + behind)[:, 1:, None, :] - total[:, None, None, None]) * both
        slopes = (np.tensordot(x, one - p, ((0, 1), (0, 1))), seen_pairs - joint.sum((0, 1)), (one - p)[:, 0].sum(0))
        for v, g, s in zip((field.weights, field.pairs, field.first), slopes, steps):
            g = g / len(pages) - ridge * v
            s += g * g
            v += rate * g / np.sqrt(s)
    return field


def compose(rng: random.Random, paragraphs: list[str]) -> tuple[str, list[str]]:
    """A page with some layout, and its main text by blocks."""
    say = lambda: html.escape(rng.choice(paragraphs))
    few = lambda: " ".join(rng.choice(paragraphs).split()[: rng.randint(1, 5)]) or "more"
    name = lambda kind: " ".join(rng.sample(KINDS[kind], rng.randint(1, 2)))
    links = lambda n: "<ul>" + "".join(f'<li><a href="/x">{html.escape(few())}</a></li>' for _ in range(n)) + "</ul>"
    side = {
        "advert": lambda: f'<div class="{name("advert")}">{say()}</div>',
        "menu": lambda: rng.choice([f"<nav>{links(rng.randint(2, 8))}</nav>", f'<div class="{name("menu")}">{links(5)}</div>']),
        "side": lambda: rng.choice([f"<aside><h3>{few()}</h3><p>{say()}</p></aside>", f'<div class="{name("side")}"><h4>{few()}</h4>{links(4)}<p>{say()}</p></div>']),
        "notice": lambda: f'<div class="{name("notice")}"><p>{say()}</p></div>',
        "form": lambda: f'<form class="{name("form")}"><label>{few()}</label><input name="q"><p>{say()}</p></form>',
        "comment": lambda: f'<{(t := rng.choice(["div", "section"]))} {rng.choice(["class", "id"])}="{name("comment")}"><h3>{few()}</h3>' + "".join(f'<div class="comment"><p>{say()}</p></div>' for _ in range(rng.randint(1, 4))) + f"</{t}>",
        "share": lambda: f'<div class="{name("share")}">{few()}</div>',
        "foot": lambda: rng.choice([f"<footer>&copy; {few()} &middot; {say()}</footer>", f'<div class="{name("foot")}"><p>{say()}</p></div>']),
        "head": lambda: rng.choice([f"<header><h1>{few()}</h1><p>{say()}</p></header>", f'<div class="{name("head")}"><h2>{few()}</h2></div>']),
    }
    some = lambda kinds, p=0.5: "".join(side[k]() for k in kinds if rng.random() < p)
    body, text = [], []
    for tag in ["h1", *[rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote"]) for _ in range(rng.randint(1, 12))]]:
        words = few() if tag in ("h1", "h2") else rng.choice(paragraphs)
        inner = html.escape(words)
        if tag == "p" and rng.random() < 0.2 and " " in inner:
            a, _, b = inner.partition(" ")
            inner = f'{a} <a href="/y">{b}</a>' if len(b) < 40 else f"<b>{a}</b> {b}"
        body.append(f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>" if rng.random() < 0.8 or tag != "p" else f"<p>{inner}")
        text.append(" ".join(words.split()))
        if rng.random() < 0.12:
            body.append(side[rng.choice(["advert", "share", "side", "notice", "form"])]())
    late = some(["comment", "side"], 0.3)
    wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="{}">{{}}</div>'.format(rng.choice(["content", "post", "entry", "article body", "story", "main text"])), "<div>{}</div>"])
    page = some(["notice", "head", "menu", "form", "advert"]) + wrap.format("".join(body) + late) + some(["share", "side", "comment", "advert", "form", "foot"])
    return f"<!DOCTYPE html><html><head><title>{few()}</title><style>p{{}}</style></head><body>{page}</body></html>", text


def _labels(blocks: list[Block], text: list[str]) -> list[int]:
    """Which blocks make up ``text``, in order: the last run that does."""
    out, k = [0] * len(blocks), len(text) - 1
    for j in range(len(blocks) - 1, -1, -1):
        inside = {"article", "main"} & set(blocks[j].tags) or "main" in set().union(*blocks[j].kinds) or not any(blocks[j].kinds)
        side = {"aside", "form", "nav", "footer", "header"} & set(blocks[j].tags) or set().union(*blocks[j].kinds) - {"main"}
        if k >= 0 and blocks[j].text == text[k] and inside and not side:
            out[j], k = 1, k - 1
    return out


def fit(pages: list[str | None], seed: int = 11) -> Field:
    """A field trained on pages that mark up their article and on pages composed from their texts."""
    rng, known, paragraphs = random.Random(seed), [], []
    for page in pages:
        blocks = blocks_of(page)
        label = [int(bool({"article", "main"} & set(b.tags)) and not {"nav", "aside", "form", "footer"} & set(b.tags)) for b in blocks]
        if 0 < sum(label) and len(blocks) <= SAMPLE_BLOCKS:
            known.append((features(blocks), label))
        paragraphs += [b.text for b in blocks if len(b.text) < COMPOSED_CHARS][:COMPOSED_BLOCKS]
    paragraphs = paragraphs or ["Some words of a page, for want of any other.", "Another sentence follows.", "More"]
    for _ in range(max(len(pages), 300)):
        page, text = compose(rng, paragraphs)
        blocks = blocks_of(page)
        if len(blocks) <= SAMPLE_BLOCKS:
            known.append((features(blocks), _labels(blocks, text)))
    return train_field(known)


def _fitted_rows(batches):
    """The field of all pages, pickled."""
    pages = [p for batch in batches for p in batch.column("html").to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pages))], pa.binary())], names=["field"])


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Field:
    """Fits, in one task, on the pages with the smallest hashes of their ids, up to a size; only those pages leave the tasks that read them.

    Null pages are not trained on; of equal rows each counts.  Without pages the
    field is fitted on composed ones alone.
    """
    own = F.xxhash64("html")
    fitting = pages.where(F.length("html") <= SAMPLE_CHARS)
    chosen = smallest(fitting.select("page_id", own.alias("own")), F.xxhash64("page_id"), sample_pages, "page_id", "own").distinct()
    c = chosen.select(F.col("page_id").alias("chosen_id"), F.col("own").alias("chosen_own"))
    # at most sample_pages pairs of two numbers: bounded, so broadcast
    rows = fitting.join(F.broadcast(c), F.col("page_id").eqNullSafe(F.col("chosen_id")) & (own == F.col("chosen_own")), "left_semi")
    rows = rows.orderBy(F.xxhash64("page_id"), "page_id", own).limit(sample_pages).select("html")
    found = rows.coalesce(1).mapInArrow(bw.giving_back(_fitted_rows), "field binary").first()
    return pickle.loads(found.field) if found else fit([])


def main_text(page: str | None, field: Field) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, y in zip(blocks, field.labels(features(blocks))) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of the main text of every row of ``pages``.

    A null or empty page, and one without text, gives the empty text.  Repeated
    rows give equal texts; null ids and urls are kept; other columns are not
    read.  Pages of any length are read whole.
    """
    field = field or train(pages)

    def rows(batches):
        for batch in batches:
            text = pa.array([main_text(p, field) for p in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text], names=["page_id", "url", "text"])

    found = pages.select("page_id", "url", "html").mapInArrow(bw.giving_back(rows), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
