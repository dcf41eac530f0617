"""Main text of web pages: page structure first, a host suffix array for the rest.

Parsing yields the visible blocks of a page, each marked by where it stands: inside
the article, inside something that never is article text (menus, footers, forms,
notices, adverts, comments and the like), or neither. Article blocks are the text of
a page that has any; passages that several articles share stay, as they belong to
each of them.

Outside articles the token streams of all pages of a host are one concatenated text.
Its suffixes, cut at ``DEPTH`` words, are ordered by Spark under their host; suffixes
that agree to that depth on two distinct pages are boilerplate, and every word that
such a suffix covers is removed. The unique runs that remain in blocks of no certain
kind are the text of pages without an article. Sorting by host and suffix head splits
a large host over many tasks, and the smallest and largest page of a head are
combined before the shuffle.

Edge cases: a null or empty page has an empty text; white space of any kind in a
block is one space; unclosed elements end with their parent, an unclosed comment or
script with the page; a null url is a host of its own; equal pages count by their
ids, so rows with one id are one page; other columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import stored

DEPTH = 8

#: Elements whose content is no markup, up to their own end tag or the end of the page.
RAW = re.compile(r"(script|style|noscript|template|svg|textarea|select|iframe|object|canvas|math)\b", re.I)
RAW_END = {
    name: re.compile(rf"</{name}\s*>", re.I)
    for name in "script style noscript template svg textarea select iframe object canvas math".split()
}
TAG_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl menu table tbody thead tfoot tr td th "
    "blockquote figure fieldset details dialog center".split()
)
NEVER = frozenset("head title nav footer aside form menu dialog button fieldset".split())
NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice alert newsletter subscribe subscription sidebar rail widget widgets menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar toolbar comment comments discussion disqus respond replies reply related recommended "
    "share sharing social popup modal overlay pagination pager login signup signin register search skip legal copyright "
    "contentinfo complementary tags".split()
)
#: Words that name no content: beside them a compound such as "site-footer" means what its other word means.
PLAIN_NAMES = frozenset(
    "site page main global primary secondary left right top bottom upper lower block box area section region wrap wrapper "
    "container inner outer holder group row col column list item items link links button buttons icon icons bar form slot "
    "unit module panel title heading text post posts article articles entry story by".split()
)
#: Elements that hold the page's text whatever a class says about its layout.
WHOLE = frozenset("html body main article".split())
ARTICLE_NAMES = frozenset("article articlebody main content post entry story".split())


def _never(token: str) -> set[str]:
    """Names of no use in a class, id or role; "no-sidebar" or "post-share-prices-fall" have none."""
    names = set(NAME.findall(token))
    found = names & (NEVER_NAMES | {"header"})
    return found if names <= found | PLAIN_NAMES else set()


def _kind(tag: str, attributes: str, inside: bool) -> int:
    """-1 never text, 1 article, 2 a likely article container, 0 nothing known."""
    if tag in NEVER or (tag == "header" and not inside):
        return -1
    names: set[str] = set()
    never: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return -1
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return -1
        else:
            names.update(NAME.findall(value))
            if tag not in WHOLE:
                never.update(*map(_never, value.split()))
    if never & NEVER_NAMES or ("header" in never and not inside):
        return -1
    if tag in ("article", "main"):
        return 1
    return 2 if tag != "body" and names & ARTICLE_NAMES else 0


class TagEnds:
    """Where tags end: at the first ``>`` outside quotes.

    What was found from one place is remembered for all places that lead there, so a page
    is scanned once however many of its tags are never closed.
    """

    def __init__(self, page: str):
        self.page = page
        self.seen = (0, -1)  # no special character between the two places but at the second
        self.known: dict[int, int] = {}

    def _special(self, at: int) -> int:
        """Place of the next quote or ``>``; the length of the page if there is none."""
        start, found = self.seen
        if not start <= at <= found:
            m = SPECIAL.search(self.page, at)
            found = m.start() if m else len(self.page)
            self.seen = (at, found)
        return found

    def after(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes begin at ``at``; -1 without."""
        first = at = self._special(at)
        passed = []
        while at not in self.known:
            if at >= len(self.page):
                self.known[at] = -1
            elif self.page[at] == ">":
                self.known[at] = at
            else:
                passed.append(at)
                close = self.page.find(self.page[at], at + 1)
                if close < 0:
                    self.known[at] = -1
                else:
                    at = self._special(close + 1)
        for place in passed:
            self.known[place] = self.known[at]
        return self.known[first]


def tokens(page: str) -> Iterator[tuple[int, int, str, str | None, str]]:
    """Start, end, slash, name and attributes of every tag; no name for comments and raw elements."""
    ends, last, at = TagEnds(page), page.rfind(">"), 0
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            end = len(page) if stop < 0 else stop + 3
            yield at, end, "", None, ""
            at = end
            continue
        if at > last:
            # No tag can end any more, but a comment may still begin.
            at = page.find("<!--", at)
            if at < 0:
                return
            continue
        if page[at + 1:at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, "", None, ""
            at = end
            continue
        name = TAG_NAME.match(page, at + 1)
        stop = ends.after(name.end()) if name else -1
        if stop < 0:
            at += 1
            continue
        raw = RAW.match(page, at + 1)
        if raw:
            close = RAW_END[raw[1].lower()].search(page, stop + 1)
            end = close.end() if close else len(page)
            yield at, end, "", None, ""
            at = end
            continue
        yield at, stop + 1, name[1], name[2], page[name.end():stop]
        at = stop + 1


class Open:
    """Open elements with their kinds; looks at no element twice to find none."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.count: Counter[str] = Counter()

    @property
    def kind(self) -> int:
        return self.stack[-1][1]

    @property
    def tag(self) -> str:
        return self.stack[-1][0]

    def push(self, tag: str, kind: int) -> None:
        self.stack.append((tag, kind))
        self.count[tag] += 1

    def pop(self, tag: str) -> None:
        """Close the innermost element of this tag, and all inside it."""
        while self.count[tag]:
            gone, _ = self.stack.pop()
            self.count[gone] -= 1
            if gone == tag:
                return


def parse(page: str) -> tuple[list[str], list[str], list[str]]:
    """Blocks inside the article, of no certain kind, and of no use, in page order."""
    found: dict[int, list[str]] = {1: [], 2: [], 0: [], -1: []}
    opened = Open()
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            words = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if words:
                found[opened.kind].append(words)

    for start, end, slash, name, attributes in tokens(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if name is None:
            continue
        tag = name.lower()
        if tag in INLINE:
            if slash:
                if opened.count[tag]:
                    flush()
                    opened.pop(tag)
            elif attributes and _kind(tag, attributes, opened.kind > 0) < 0 and not attributes.endswith("/"):
                flush()
                opened.push(tag, -1)
            continue
        flush()
        if slash:
            opened.pop(tag)
            continue
        if tag == "body":
            opened.pop("head")
        if opened.tag == "p":
            opened.pop("p")
        above = opened.kind
        kind = _kind(tag, attributes, above > 0)
        if tag in CONTAINERS or kind:
            new = -1 if above < 0 or kind < 0 else (1 if above == 1 or kind == 1 else (2 if above == 2 or kind == 2 else 0))
            opened.push(tag, new)
    parts.append(page[at:])
    flush()
    if found[1]:
        return found[1], found[2] + found[0], found[-1]
    return found[2], found[0], found[-1]


def blocks(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, article, open, rest``: the blocks of every page by kind."""
    kind = dict(pages.dtypes)["page_id"]
    texts = pa.list_(pa.string())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(p or "") for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([r[i] for r in rows], texts) for i in range(3)]],
                names=["page_id", "url", "article", "open", "rest"],
            )

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    columns = "array<string>"
    parsed = pages.select("page_id", "url", "html").mapInArrow(
        split, f"page_id {kind}, url string, article {columns}, open {columns}, rest {columns}"
    )
    return parsed.withColumn("host", host)


def suffix_heads(parsed: DataFrame) -> DataFrame:
    """``host, page_id, at, head``: a hash of the next ``DEPTH`` words of every suffix.

    The stream of a page is its open blocks and then the rest; ``at`` counts words.
    """
    kind = dict(parsed.dtypes)["page_id"]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(2)):
                starts, ends = V.runs(V.NOT_SPACE[block.data], block.offsets)
                owner = block.owner(starts)
                head = V.shingle_hash(V.span_hash(V.prefix_hash(block.data), starts, ends), DEPTH)
                whole = np.flatnonzero(owner[: len(head)] == owner[DEPTH - 1 :]) if len(head) else np.zeros(0, np.int64)
                first = np.searchsorted(owner, np.arange(block.n + 1))
                at = whole - first[owner[whole]]
                rows = pa.array(owner[whole] + block.lo)
                yield V.output({
                    "host": (batch.column(0).take(rows), None), "page_id": (batch.column(1).take(rows), None),
                    "at": (at, pa.int32()), "head": (head[whole].view(np.int64), pa.int64()),
                })

    stream = F.array_join(F.concat("open", "rest"), " ")
    return parsed.select(F.xxhash64("host").alias("host"), "page_id", stream.alias("stream")).mapInArrow(
        heads, f"host bigint, page_id {kind}, at int, head bigint"
    )


def covered_words(parsed: DataFrame) -> DataFrame:
    """``page_id, at``: sorted starts of suffixes whose head occurs on two pages of the host."""
    heads = suffix_heads(parsed)
    order = heads.groupBy("host", "head").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"))
    repeated = order.where("lo < hi").select("host", "head")
    # Only pages whose text is still open ask for positions.
    asking = suffix_heads(parsed.where(F.size("article") == 0))
    return (
        asking.join(repeated, ["host", "head"], "left_semi")
        .groupBy("page_id").agg(F.sort_array(F.collect_set("at")).alias("at"))
    )


def unique_runs(open_blocks: list[str], starts: list[int]) -> str:
    """Words of the open blocks that no repeated suffix covers."""
    words = [w for b in open_blocks for w in b.split(" ")]
    delta = np.zeros(len(words) + 1, dtype=np.int64)
    for s in starts:
        if s < len(words):
            delta[s] += 1
            delta[min(s + DEPTH, len(words))] -= 1
    return " ".join(w for w, c in zip(words, np.cumsum(delta)) if not c)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    parsed = stored(blocks(pages), "html-blocks")
    kind = dict(pages.dtypes)["page_id"]
    done = parsed.where(F.size("article") > 0).select("page_id", "url", F.array_join("article", " ").alias("text"))
    rest = (
        parsed.where(F.size("article") == 0).select("page_id", "url", "open")
        .join(covered_words(parsed), "page_id", "left")
    )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [unique_runs(b, s or []) for b, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string())], names=["page_id", "url", "text"])

    cleaned = rest.select("page_id", "url", "open", "at").mapInArrow(clean, f"page_id {kind}, url string, text string")
    return done.unionByName(cleaned).withColumn("n_chars", F.length("text").cast("bigint"))
