"""Main text of web pages, with templates of a site removed.

A page is read once into a tree. Elements that never hold article text (menus, forms, scripts and
so on, by tag, role or class name) are left out. What is left is hashed bottom-up: an element's hash
follows from its tag, its text and its children. Spark counts, per host, in how many different
pages a subtree occurs; copies of one page count once, so that a page that was published often does
not look like a template. Subtrees found in more than ``share`` of a host's different pages (and in
at least ``least_pages`` of them) are its template and are deleted. The text of the article
elements, else of the main element, else of the body is what remains.

The counting moves one small row per element; hot hosts are summed inside the tasks first. The
deletions come back to the pages by page, not by host, so a host with a third of all pages is no
hot key.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import in_pieces, strings
from textloom.llm.url_templates import url_parts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ARTICLE = re.compile(r"<(?:article|main)[\s>]", re.I)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Element names of HTML by what this module does with them.
VOID = frozenset(
    "area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
DROPPED = RAW | frozenset(
    "head nav aside form button select dialog menu object canvas video audio".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
    "form".split())
#: Words in a class or id that mark an element as no part of the article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie "
    "cookies consent notice popup modal overlay newsletter subscribe subscription share sharing "
    "social comment comments disqus replies related recommended login signup pagination pager "
    "widget toolbar".split())
#: Words that make a class tell of a page's layout or state rather than of the element's content.
STATE_WORDS = frozenset("has no not with without enabled disabled".split())
#: Sections made of small articles of their own.
CARD_WORDS = frozenset("comment comments disqus related recommended replies".split())
#: An element that begins inside one of these ends it.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "option", "tbody", "td", "tfoot", "th",
                    "thead", "title", "tr", "li", "dd", "dt", "summary"} | {"li", "dd", "dt"}
_KEEPS_INSIDE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
                 "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}


class _Element:
    __slots__ = ("tag", "parts", "hash")

    def __init__(self, tag: str):
        self.tag = tag
        self.parts: list = []  # text pieces and elements, in page order
        self.hash = 0


def _unwanted(tag: str, attributes: str, in_article: bool) -> str:
    """Why an element is no part of the article: ``tag``, ``mark``, ``card`` or nothing."""
    if tag in DROPPED or (tag == "footer") or (tag == "header" and not in_article):
        return "tag"
    if not attributes or tag in HEADINGS or tag in ("html", "body", "main"):
        return ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            if DROPPED_ROLES.intersection(re.split(r"[\s_-]+", value)):
                return "tag"
        elif tag != "article" or name.lower() == "class":
            marked = set()
            for one in value.split():
                words = set(re.split(r"[_-]+", one))
                if not words & STATE_WORDS:
                    marked |= words & DROPPED_WORDS
            if marked - {"header"} or ("header" in marked and not in_article):
                return "card" if marked & CARD_WORDS else "mark"
    return ""


class _Ends:
    """Where elements end, found once per page and tag."""

    def __init__(self, source: str):
        self.source = source
        self.by_tag: dict[str, dict[int, int]] = {}
        self.articles = [m.start() for m in _ARTICLE.finditer(source)]

    def _matched(self, tag: str) -> dict[int, int]:
        ends, open_ = {}, []
        for token in re.compile(
            rf"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?){re.escape(tag)}(?=[\s/>])",
            re.I | re.S,
        ).finditer(self.source):
            if token[2] is None:
                continue
            if not token[2]:
                open_.append(token.start())
            elif open_:
                close = self.source.find(">", token.end())
                ends[open_.pop()] = len(self.source) if close < 0 else close + 1
        return ends

    def of(self, tag: str, start: int, at: int) -> int:
        """The end of the element whose start tag lies from ``start`` to ``at``; -1 if it is never
        closed and so ends where its parent does."""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.source, at)
            return end.end() if end else len(self.source)
        if tag not in self.by_tag:
            self.by_tag[tag] = self._matched(tag)
        return self.by_tag[tag].get(start, -1)

    def is_page(self, start: int, end: int) -> bool:
        """Whether a stretch is most of the page and holds its article."""
        first = bisect_left(self.articles, start)
        return 2 * (end - start) > len(self.source) and (
            first < len(self.articles) and self.articles[first] < end)


def parse(source: str) -> _Element:
    """The wanted elements of a page."""
    root = _Element("")
    stack, ends = [root], _Ends(source)
    articles = at = 0
    last = source.rfind(">")  # nothing behind it can be a tag
    while at < len(source):
        token = _TOKEN.search(source, at) if at <= last else None
        if token is None:
            stack[-1].parts.append(source[at:])
            break
        if token.start() > at:
            stack[-1].parts.append(source[at:token.start()])
        at = token.end()
        if not token[2]:
            continue  # comments, doctypes, instructions
        tag = token[2].lower()
        if token[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    articles -= sum(e.tag == "article" for e in stack[depth:])
                    del stack[depth:]
                    break
            continue
        if tag == "br":
            stack[-1].parts.append(" ")
            continue
        if tag in VOID:
            continue
        while len(stack) > 1 and (
            (stack[-1].tag in CLOSES.get(tag, ())) or (stack[-1].tag == "p" and tag in _ENDS_P)
        ):
            stack.pop()
        if tag in _ENDS_P:  # a paragraph left open below inline elements
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS:
                    break
        elif tag in CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in CLOSES[tag]:
                    del stack[depth:]
                    break
                if stack[depth].tag in _KEEPS_INSIDE[tag]:
                    break
        reason = _unwanted(tag, token[3], articles > 0)
        if reason:
            end = -1 if token[3].endswith("/") and tag in ("svg", "math") else ends.of(
                tag, token.start(), at)
            # A class word does not do away with an element that is most of the page.
            if reason == "mark" and ends.is_page(
                token.start(), end if end >= 0 else len(source)):
                reason = ""
        if reason:
            if end >= 0:
                at = end
                if tag in BLOCKS:
                    stack[-1].parts.append(_Element("gap"))
                continue
            stack[-1].parts.append(_Element("gap"))
            stack.append(_Element(tag))  # never closed: read on, attached to nothing
            continue
        element = _Element(tag)
        stack[-1].parts.append(element)
        stack.append(element)
        articles += tag == "article"
    return root


def _walk(root: _Element) -> list[_Element]:
    """An element and all below it, parents first."""
    out, stack = [], [root]
    while stack:
        element = stack.pop()
        out.append(element)
        stack.extend(p for p in reversed(element.parts) if not isinstance(p, str))
    return out


def hash_subtrees(root: _Element) -> list[int]:
    """Sets the hash of every element, children first; the hashes of those that hold text."""
    filled, hashes = set(), []
    for element in reversed(_walk(root)):
        state = hashlib.blake2b(element.tag.encode(), digest_size=8)
        holds = False
        for part in element.parts:
            if isinstance(part, str):
                words = part.split()
                holds = holds or bool(words)
                state.update(b"\0" + " ".join(words).encode())
            else:
                holds = holds or id(part) in filled
                state.update(b"\1" + part.hash.to_bytes(8, "little", signed=True))
        element.hash = int.from_bytes(state.digest(), "little", signed=True)
        if holds:
            filled.add(id(element))
            hashes.append(element.hash)
    return hashes


def _roots(root: _Element) -> list[_Element]:
    """The outermost articles, else the outermost main elements, else everything."""
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            element = stack.pop()
            if element.tag == wanted:
                found.append(element)
            else:
                stack.extend(p for p in reversed(element.parts) if not isinstance(p, str))
        if found:
            return found
    return [root]


def blocks(root: _Element, deleted: frozenset[int] = frozenset()) -> list[str]:
    """Text of each block in page order, white space inside a block as one space."""
    out: list[str] = []
    current: list[str] = []

    def finish() -> None:
        text = " ".join(html.unescape("".join(current)).split())
        if text:
            out.append(text)
        current.clear()

    for top in _roots(root):
        finish()
        # Depth first without recursion: (element, next part).
        if top.hash in deleted:
            continue
        stack = [(top, 0)]
        while stack:
            element, i = stack.pop()
            if i == len(element.parts):
                if element.tag in BLOCKS:
                    finish()
                continue
            stack.append((element, i + 1))
            part = element.parts[i]
            if isinstance(part, str):
                current.append(part)
            elif part.tag == "gap":
                finish()
            elif part.hash not in deleted:
                if part.tag in BLOCKS:
                    finish()
                stack.append((part, 0))
            elif part.tag in BLOCKS:
                finish()
    finish()
    return out


def _signed(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_pieces(batches):
        keys, hosts, contents, hashes = [], [], [], []
        for key, host, source in zip(
            batch.column("key").to_pylist(), batch.column("host").to_pylist(),
            strings(batch.column("html")), strict=True,
        ):
            own = set(hash_subtrees(root := parse(source)))
            keys += [key] * len(own)
            hosts += [host] * len(own)
            contents += [root.hash] * len(own)
            hashes += own
        yield pa.record_batch([
            pa.array(keys, pa.int64()), pa.array(hosts, pa.string()),
            pa.array(contents, pa.int64()), pa.array(hashes, pa.int64()),
        ], names=["key", "host", "content", "subtree"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [None if p is None else zlib.compress(p, 1)
                 for p in batch.column("html").cast(pa.binary()).to_pylist()]
        yield pa.record_batch(
            [*(batch.column(c) for c in ("key", "page_id", "url")), pa.array(pages, pa.binary())],
            names=["key", "page_id", "url", "html"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_pieces(batches):
        texts = []
        for page, deleted in zip(
            batch.column("html").to_pylist(), batch.column("deleted").to_pylist(), strict=True
        ):
            root = parse("" if page is None else zlib.decompress(page).decode())
            if deleted:
                hash_subtrees(root)
            texts.append("\n".join(blocks(root, frozenset(deleted or ()))))
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
            names=["page_id", "url", "text"])


def extract_main_text(
    pages: DataFrame, share: float = 0.5, least_pages: int = 10
) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every page.

    Null html counts as empty, a null url as the host ``""``. An empty table gives no rows.
    """
    host, _ = url_parts(F.col("url"))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"),
        # Rows equal in all columns share a key, which is right: they have the same deletions.
        F.xxhash64("page_id", "url", "html").alias("key"))
    subtrees = keyed.select("key", "host", "html").mapInArrow(
        _subtrees, "key long, host string, content long, subtree long")
    # Different pages per subtree and per host; the distinct step also sums inside the tasks.
    seen = subtrees.select("host", "content", "subtree").distinct()
    per_subtree = seen.groupBy("host", "subtree").agg(F.count("*").alias("pages")).where(
        F.col("pages") >= least_pages)
    per_host = seen.groupBy("host", "content").agg(F.count("*")).groupBy("host").agg(
        F.count("*").alias("host_pages"))
    template = per_subtree.join(per_host, "host").where(
        F.col("pages") > F.col("host_pages") * share).select("host", "subtree")
    deletions = subtrees.join(template, ["host", "subtree"], "left_semi").groupBy("key").agg(
        F.collect_set("subtree").alias("deleted"))
    # Pages travel compressed: markup shrinks to a fraction.
    packed = keyed.select("key", "page_id", "url", "html").mapInArrow(
        _pack, "key long, page_id long, url string, html binary")
    return packed.join(deletions, "key", "left").select(
        "page_id", "url", "html", "deleted",
    ).mapInArrow(_extract, "page_id long, url string, text string").select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
