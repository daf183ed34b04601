"""Main text of web pages by consensus paths of hosts.

Each page's containers are scored by the prose in them. Spark adds the scores up per host and generalised tag-class
path, and the best path of each host is its consensus. Every page is then extracted anew by its host's path, widened
to the article that it is in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import pieces_of, stored
from saleslake.operators.joins import lookup_join

CONTAINERS = frozenset(
    "html body main article section div aside nav header footer form fieldset table tbody thead tfoot tr td th ul ol li dl dt dd "
    "blockquote figure figcaption details summary center head dialog menu".split()
)
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre address hr option legend caption br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no markup, or is never shown as text.
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp template svg math object select button video audio canvas".split())
NOISE_TAGS = frozenset("head nav footer aside form dialog menu fieldset".split())
# An open element of the first kind ends where one of the second starts.
_ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENTRIES = frozenset("p pre blockquote br li dt dd td th caption figcaption".split())
_SCOPES = frozenset(["ul", "ol", "dl", "table", "body"])

# Words of class, id and role attributes that mark what is no part of an article ...
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar sidenav complementary widget widgets footer contentinfo header masthead topbar cookie "
    "cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal dialog overlay paywall social share "
    "sharing related recommended recommendations comment comments commentlist disqus reply replies respond discussion login search "
    "searchbox pagination pager copyright legal disclaimer toolbar skip hidden feedback".split()
)
# ... what marks an article ...
_ARTICLE = frozenset("article content main post entry story".split())
# ... and what says that an element only has such a part.
_HAS = frozenset("with has no without".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*+>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
_DIGITS = re.compile(r"\d+")
_64_BITS = (1 << 64) - 1
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {tag: re.compile(f"</{tag}(?![a-z0-9-])[^>]*>?", re.I) for tag in RAW}
_WORD = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in _ATTRIBUTE.findall(text)}


def _is_noise(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in NOISE_TAGS:
        return True
    if tag == "header" and not inside_article:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if _UNSEEN.search(attributes.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    names = [_WORD.findall(_CAMEL.sub(" ", name).lower()) for x in ("class", "id", "role") for name in attributes.get(x, "").split()]
    if any(len(words) == 1 and words[0] in _ARTICLE for words in names):
        return False
    return any(_is_noise_name([w for w in words if not w.isdigit()], inside_article) for words in names)


def _is_noise_name(words: list[str], inside_article: bool) -> bool:
    """A name such as `post-comments` or `ad-box` by its words: one at either end counts, one within unless an article's name is meant."""
    marked = [w in _NOISE and not (inside_article and w == "header") for w in words]
    if not any(marked) or _HAS & set(words):
        return False
    return marked[0] or marked[-1] or not _ARTICLE & set(words)


def path_key(outer: int, tag: str, classes: str) -> int:
    """The path of a container as a number: that of the path around it and its own tag and classes, digits generalised."""
    names = sorted({_DIGITS.sub("#", x) for x in classes.lower().split()})
    found = xxhash.xxh64_intdigest(".".join([tag, *names]), outer & _64_BITS)
    return found - (1 << 64) if found >> 63 else found


class Page:
    """The containers of a page with their paths and scores, and its blocks of text outside of noise.

    Time and memory grow with the page's length, however deep its containers are: a path is a number, scores are added up to the
    containers around once at the end, and what is open is counted by tag.
    """

    def __init__(self, html: str):
        self.parent = [-1]
        self.path = [0]
        self.depth = [0]
        self.tag = [""]
        self.score = [0.0]
        # (container, text, whether it is a heading, entry or prose)
        self.blocks: list[tuple[int, str, bool]] = []
        # (tag, container, noise, whether an article is open)
        self._stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self._open: Counter[str] = Counter()
        self._runs: list[str] = []
        self._linked = 0
        self._kind = ""
        self._read(html)
        for i in range(len(self.score) - 1, 0, -1):
            self.score[self.parent[i]] += self.score[i]

    def _push(self, tag: str, container: int, noise: bool) -> None:
        self._stack.append((tag, container, noise, self._stack[-1][3] or tag in ("article", "main")))
        self._open[tag] += 1

    def _pop(self, depth: int) -> None:
        """Close everything from this depth on."""
        for tag, *_ in self._stack[depth:]:
            self._open[tag] -= 1
        del self._stack[depth:]

    def _read(self, html: str) -> None:
        at, links = 0, 0
        scan = _TAG.search
        while found := scan(html, at):
            if found.start() > at:
                self._text(html[at : found.start()], links)
            at = found.end()
            tag = found[2]
            if tag is None:
                if found[0].startswith("<![CDATA["):
                    self._text(found[0][9:].removesuffix("]]>"), links)
                continue
            tag = tag.lower()
            if found[1]:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in BLOCKS:
                    self._flush()
                self._close(tag)
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag == "a":
                links += 1
            attributes = _attributes(found[3]) if found[3] else {}
            if tag in BLOCKS:
                self._flush()
                self._imply(tag)
                self._kind = tag
            if tag in VOID:
                continue
            _, outer, in_noise, inside_article = self._stack[-1]
            noise = in_noise or _is_noise(tag, attributes, inside_article)
            if tag in CONTAINERS:
                self.parent.append(outer)
                self.path.append(path_key(self.path[outer], tag, attributes.get("class", "")))
                self.depth.append(self.depth[outer] + 1)
                self.tag.append(tag)
                self.score.append(0.0)
                self._push(tag, len(self.path) - 1, noise)
            elif tag in BLOCKS or noise:
                self._push(tag, outer, noise)
        if at < len(html):
            self._text(html[at:], links)
        self._flush()

    def _text(self, text: str, links: int) -> None:
        if self._stack[-1][2]:
            return
        self._runs.append(text)
        if links:
            self._linked += len(text)

    def _flush(self) -> None:
        if not self._runs:
            return
        text = " ".join(unescape("".join(self._runs)).split())
        self._runs.clear()
        linked, self._linked = self._linked, 0
        if not text:
            return
        container = self._stack[-1][1]
        heading = self._kind in _HEADINGS
        links = 2 * linked > len(text)
        self.blocks.append((container, text, heading or not links and (self._kind in _ENTRIES or len(text) >= 40)))
        weight = float(len(text))
        if links:
            weight = -weight
        elif heading:
            weight = 0.0
        elif self._kind not in ("p", "pre", "blockquote", "br") and len(text) < 40:
            weight = -weight / 2
        self.score[container] += weight

    def _close(self, tag: str) -> None:
        if not self._open[tag]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth][0] == tag:
                self._pop(depth)
                return

    def _imply(self, tag: str) -> None:
        """Close what ends where `tag` starts: an open paragraph, a list item, a table cell, the head."""
        if tag == "br":
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            open_tag = self._stack[depth][0]
            if open_tag == "p" or (open_tag == "head" and tag not in ("head", "html")):
                self._pop(depth)
                return
            if open_tag in CONTAINERS:
                break
        if tag in _ENDS and any(self._open[x] for x in _ENDS if tag in _ENDS[x]):
            for depth in range(len(self._stack) - 1, 0, -1):
                open_tag = self._stack[depth][0]
                if open_tag in _SCOPES:
                    return
                if tag in _ENDS.get(open_tag, ()):
                    self._pop(depth)
                    return

    def votes(self) -> dict[int, float]:
        """Score of each path that holds prose; containers of one path add up, and the deeper of equals is ahead."""
        found: dict[int, float] = {}
        for path, depth, score in zip(self.path[1:], self.depth[1:], self.score[1:], strict=True):
            if score > 0:
                found[path] = found.get(path, 0.0) + score * (1 + 0.01 * depth)
        return found

    def text(self, consensus: int | None) -> str:
        """The blocks in the containers of the consensus path, or in the page's own best ones where it has no such.

        A page that holds less than half as much prose in the path as in its own best one has another template. Headings,
        lists, tables and prose beside the containers are text too: of the article around them, or up to where links are.
        """
        votes = self.votes()
        if votes:
            own = max(votes, key=lambda path: (votes[path], path))
            chosen = consensus if consensus in votes and 2 * votes[consensus] >= votes[own] else own
            inside = [path == chosen for path in self.path]
            self._spread(inside)
            self._widen(inside)
            return " ".join(text for container, text, _ in self.blocks if inside[container])
        return " ".join(text for _, text, _ in self.blocks)

    def _spread(self, inside: list[bool]) -> None:
        """To what is in containers that are inside."""
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parent[i]]

    def _widen(self, inside: list[bool]) -> None:
        """To the nearest article around, or else as far out as all other blocks are headings, entries or prose."""
        article = [0] * len(inside)
        other = [False] * len(inside)
        for container, _, belongs in self.blocks:
            if not inside[container] and not belongs:
                other[container] = True
        for i in range(1, len(inside)):
            article[i] = i if self.tag[i] in ("article", "main") else article[self.parent[i]]
        for i in range(len(inside) - 1, 0, -1):
            other[self.parent[i]] = other[self.parent[i]] or other[i]
        tops = [i for i in range(1, len(inside)) if inside[i] and not inside[self.parent[i]]]
        for i in tops:
            if article[i]:
                inside[article[i]] = True
                continue
            while i and not other[self.parent[i]]:
                i = self.parent[i]
                inside[i] = True
        self._spread(inside)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def consensus_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the highest sum of scores over the pages of each host, of equal ones the greatest number."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 256):
            summed: dict[tuple[str, int], float] = {}
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, score in Page(html).votes().items():
                    summed[name, path] = summed.get((name, path), 0.0) + score
            rows = [(name, path, score) for (name, path), score in summed.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())],
                names=["host", "path", "score"],
            )

    votes = pages.where("html is not null").select(host(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path long, score double")
    # Rounded, so that the order of addition can't change the winner.
    summed = votes.groupBy("host", "path").agg(F.round(F.sum("score"), 3).alias("score"))
    return summed.groupBy("host").agg(F.max(F.struct("score", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, by its host's consensus path.

    A null or empty html gives an empty text; pages without a usable url share the empty host; a page without any
    container gives all of its text. Repeated rows give repeated rows; an empty table gives none. Further columns
    are ignored. A host with most of the pages is no burden: its paths are summed per batch before the shuffle.
    """
    paths = stored(consensus_paths(pages), "paths")
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    found = lookup_join(keyed, paths, "host", "left", ["page_id", "url"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 256):
            texts = [Page(html).text(path) if html else "" for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return found.select("page_id", "url", "html", "path").mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
