"""Records of reports on catalogue pages: identity, dates and links of each entry, and the next page.

HTML needs a tree, which Spark has not; pages are read in Arrow batches, each
page apart.  The walk over pages is a join of a table of (url, next_url) with
itself, round by round, up to a cap that is the feature.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_text, reference_period, report_number

_SKIP = frozenset("script style noscript footer template".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SUBJECT = re.compile(r"\breporte\w*\b.*\bconfl\w*", re.I | re.S)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    items: list = field(default_factory=list)

    def text(self, stop: frozenset[str] = frozenset()) -> str:
        parts = [x if isinstance(x, str) else "" if x.tag in stop else x.text(stop) for x in self.items]
        return " ".join("".join(p if k == 0 else f" {p}" for k, p in enumerate(parts)).split())

    def all(self, *tags: str):
        for x in self.items:
            if isinstance(x, Node):
                if x.tag in tags or (x.attrs.get("class") and any(t.startswith(".") and t[1:] in x.attrs["class"].split() for t in tags)):
                    yield x
                yield from x.all(*tags)

    def inside(self, node: Node) -> bool:
        up = self.parent
        while up is not None and up is not node:
            up = up.parent
        return up is node


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", {})
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skipping += 1
        if self.skipping:
            return
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        if not self.skipping and tag not in _SKIP:
            self.at.items.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skipping = max(0, self.skipping - 1)
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None and not self.skipping:
            self.at = node.parent

    def handle_data(self, data):
        if not self.skipping:
            self.at.items.append(data)


def tree(page: str) -> Node:
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


def role_of(url: str) -> str:
    path = urlsplit(url).path.lower()
    return "direct_download" if re.search(r"\.(pdf|docx?|xlsx?|zip)$", path) else "landing_page"


# Where entries stand, by the role of the page, in order of preference.
SCOPES = {"thematic": ((".card",), ("article",)), "search": (("li",), ("article",)), "landing": (("article",), ("main",), ("body",)), "catalogue": (("article",), ("li", ".card")), "other": (("article",),)}


def _scopes(root: Node, role: str) -> list[Node]:
    """The entries of a page: the innermost elements of the first kind that names a report."""
    for kinds in SCOPES.get(role, SCOPES["other"]):
        found = [n for n in root.all(*kinds) if _SUBJECT.search(n.text())]
        inner = [n for n in found if not any(m is not n and m.inside(n) for m in found)]
        if inner:
            return inner
    return [a for a in root.all("a") if _SUBJECT.search(a.text())] or [h for h in root.all(*_HEADINGS) if _SUBJECT.search(h.text())]


def next_of(root: Node) -> str | None:
    """The next page: a link that says so, else one that is labelled so, else the current number's successor."""
    links = [a for a in root.all("a", "link") if a.attrs.get("href")]
    for a in links:
        if "next" in a.attrs.get("rel", "").lower().split():
            return a.attrs["href"]
    for a in links:
        if re.search(r"\b(siguiente|próxim[ao]|next)\b", f"{a.attrs.get('aria-label', '')} {a.attrs.get('title', '')} {a.text()}", re.I):
            return a.attrs["href"]
    for now in root.all(".current", ".active"):
        if now.text().isdigit():
            return next((a.attrs["href"] for a in links if a.text() == str(int(now.text()) + 1)), None)
    return None


def records(page: str, url: str, role: str) -> tuple[list[dict], str | None]:
    """The page's records and the next page's link."""
    root = tree(page)
    out = []
    for k, scope in enumerate(_scopes(root, role)):
        anchors = [scope] if scope.tag == "a" else list(scope.all("a"))
        anchors = [a for a in anchors if a.attrs.get("href")]
        heads = [h.text() for h in scope.all(*_HEADINGS) if h.text()]
        named = [a.text() for a in anchors if _SUBJECT.search(a.text())]
        title = (heads or named or [scope.text()])[0]
        text = scope.text()
        dated = " ".join(x for x in (p.text() for p in scope.all("p", "time", "span", "small")) if x) or text
        about = [p.text() for p in scope.all("p") if _SUBJECT.search(p.text())]
        links: dict[str, str] = {}
        for a in anchors:
            links.setdefault(urljoin(url, a.attrs["href"]), role_of(a.attrs["href"]))
        out.append({"scope": k, "title": title, "text": text, "dated": dated, "about": about, "links": [{"url": u, "role": r} for u, r in links.items()]})
    return out, next_of(root)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Records of pages (page_url, page_role, html), each with its links and the page's next link; pages without records give one row without a scope."""
    link = pa.list_(pa.struct([("url", pa.string()), ("role", pa.string())]))

    def rows(batches):
        for batch in batches:
            out = []
            for url, role, html in zip(*(batch.column(c).to_pylist() for c in ("page_url", "page_role", "html"))):
                found, nxt = records(html or "", url or "", role or "other")
                nxt = urljoin(url or "", nxt) if nxt else None
                out += [{"page_url": url, "next_url": nxt, **r} for r in found] or [{"page_url": url, "next_url": nxt}]
            names = {"page_url": pa.string(), "next_url": pa.string(), "scope": pa.int32(), "title": pa.string(), "text": pa.string(), "dated": pa.string(), "about": pa.list_(pa.string()), "links": link}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], t) for c, t in names.items()], names=list(names))

    found = pages.select("page_url", "page_role", "html").mapInArrow(rows, "page_url string, next_url string, scope int, title string, text string, dated string, about array<string>, links array<struct<url:string,role:string>>")
    number = F.coalesce(report_number(F.col("title")), report_number(F.col("text")))
    about = F.filter("about", lambda p: report_number(p).isNull() | report_number(p).eqNullSafe(F.col("number")))
    return found.withColumn("number", number).select(
        "page_url", "next_url", "scope", "number", F.coalesce(reference_period(F.col("title")), reference_period(F.col("text"))).alias("period"), "title",
        date_text(F.col("dated")).alias("date"), F.get(about, F.lit(0)).alias("description"), "links",
    )


def walk(links: DataFrame, start: str, cap: int) -> DataFrame:
    """Pages from ``start`` on along next links, with the place of each and why the walk ended; ``cap`` pages at most, which is the feature."""
    spark = links.sparkSession
    links.select("page_url", "next_url").distinct().createOrReplaceTempView("strata_next")
    rows = spark.sql("WITH RECURSIVE w(page_url, next_url, place, seen) AS (SELECT page_url, next_url, 1, array(page_url) FROM strata_next WHERE page_url = :start UNION ALL SELECT n.page_url, n.next_url, w.place + 1, array_append(w.seen, n.page_url) FROM w JOIN strata_next n ON n.page_url = w.next_url WHERE w.place < :cap AND NOT array_contains(w.seen, n.page_url)) SELECT * FROM w", args={"start": start, "cap": cap})
    last = F.when(F.col("next_url").isNull(), "no_next_link").when(F.array_contains("seen", F.col("next_url")), "repeated_url").when(F.col("place") >= cap, "page_cap")
    return rows.select("page_url", "place", last.alias("stop"))
