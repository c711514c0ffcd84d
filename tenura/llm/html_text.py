"""Main text of web pages by removal of site templates (operator 2).

1. A page is parsed to its element tree, and the subtree of every block that may be
   a template is hashed by its tags and words: menus, footers, notices and the like,
   wherever they stand; outside a marked article any block, within one only
   containers, since an article's own paragraphs can rightly recur.
2. Spark counts the hashes by host over pages of different content. What recurs on
   MIN_PAGES such pages is a template of the host; a container of more than
   BOILER_WORDS words within an article, mostly not links, on LONG_PAGES.
3. Templates are deleted. Then rules for what recurs too little to be told by its
   count delete elements that by tag, role or class are menus, headers, footers,
   sidebars, notices, adverts, forms, scripts, styles or reader comments. A class name
   of which only some words say so counts where the element is mostly links. A form
   around the article stays, its controls go. What is in a container of reader comments
   is never the article, by whatever tag.
4. On a page without an article, containers that each hold more than half of the
   unlinked words of the one above stay whatever they are called.

Parsing takes time in proportion to the page, whatever its markup.

The text of what is left has character references decoded, white space within a
block turned into one space, and blocks joined in page order by a line feed.

Defined results: null html gives an empty text; a null url has the host ''; a
page without an article element is taken whole; unclosed elements end with their
parent; repeated rows each give their row; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.common import hash64, map_batches, mix_int, stored, table

#: Pages of different content on which a template recurs; for containers of an article with more than BOILER_WORDS words, less than LINK_SHARE of them linked, LONG_PAGES.
MIN_PAGES, LONG_PAGES, BOILER_WORDS, LINK_SHARE = 5, 20, 40, 0.5
#: Templates, of 8 bytes each, that are broadcast; more are joined to their pages by a shuffle.
BROADCAST_ROWS = 2_000_000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp noembed noframes template".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
CHROME_TAGS = set("nav aside footer head script style noscript template iframe svg math button select textarea input dialog menu object canvas audio video map title".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CHROME_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead banner ad ads adv advert adverts advertisement adsense sponsor sponsored "
    "promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social comment comments reply replies "
    "disqus respond related recommended recommendations widget widgets toolbar pagination pager login search skip copyright toast".split()
)
COMMENT_WORDS = set("comment comments reply replies respond disqus".split())
#: Further words of class names that say nothing of what an element holds.
PLAIN_WORDS = set("user site page main box block list item area section wrapper wrap container inner outer content left right top bottom inline link links button buttons bar global local primary secondary the my js col row".split())
#: What may be a template within an article.
CONTAINERS = set("aside dd details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
#: A start tag on the left ends open elements of these tags.
CLOSES = {t: {"p"} for t in BLOCK - {"body", "html", "option", "optgroup", "tbody", "tfoot", "thead", "tr", "caption"}}
CLOSES |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody", "p"}, "body": {"head"}}
#: An open element of these tags keeps what is outside it open.
FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}

#: Elements that a start tag may close, or that keep it from closing others.
PLACED = BLOCK.union(*CLOSES.values(), *FENCE.values())

#: A quoted value ends before white space, / or >; a tag with another quote, which isn't closed, ends at the next >.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^>\"'])*(?=>)|[^>]*)>", re.S)  # fmt: skip
#: What a page without any further > may still hold.
_OPEN_END = re.compile(r"<!--.*\Z|<!\[CDATA\[.*\Z", re.S)
#: A reference to a character number of ten digits or more, of which leading zeros count for nothing.
_LONG_NUMBER = re.compile(r"&#0*([0-9]*);?")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def decoded(text: str) -> str:
    """text with its character references decoded; numbers beyond all characters are U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_NUMBER.sub(lambda m: "\ufffd" if len(m[1]) > 9 else m[0] if len(m[0]) < 100 else f"&#{m[1] or 0};", text)
    return html.unescape(text)


class Stack:
    """The open elements, with the places of each tag's, of blocks' and of PLACED ones."""

    def __init__(self, page: Page):
        self.page, self.nodes, self.tags = page, [0], [""]
        self.of_tag: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.placed: list[int] = []

    def push(self, node: int, tag: str) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.of_tag.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in PLACED:
            self.placed.append(at)

    def cut(self, at: int) -> None:
        """Close all from this place on."""
        while len(self.nodes) > at:
            self.page.events.append((-self.nodes.pop() - 1, None))
            self.of_tag[self.tags.pop()].pop()
        for places in (self.blocks, self.placed):
            while places and places[-1] >= at:
                places.pop()


class Page:
    """An element tree as parallel lists in page order, and the events open, text and close."""

    def __init__(self, source: str):
        self.tags, self.parents, self.chrome, self.main = [""], [-1], [False], [False]
        #: Elements with a word of CHROME_WORDS in a class or id, and whether all its words say so.
        self.named: dict[int, bool | None] = {}
        self.comments: set[int] = set()
        self.events: list[tuple[int, object]] = []  # (node, text), (node, None) opens, (-node - 1, None) closes
        self._parse(source)
        self._measure()

    def _parse(self, source: str) -> None:
        stack, at, end, last = Stack(self), 0, len(source), source.rfind(">")
        while at < end:
            found = (_TAG if at <= last else _OPEN_END).search(source, at)
            begin = found.start() if found else end
            if begin > at:
                self.events.append((stack.nodes[-1], source[at:begin]))
            if not found:
                break
            at = found.end()
            tag = found["tag"] if found.re is _TAG else None
            if not tag:
                if found[0].startswith("<![CDATA["):
                    self.events.append((stack.nodes[-1], html.escape(found[0][9:].removesuffix("]]>"))))
                continue
            tag = tag.lower()
            if found["end"]:
                self._close(stack, tag)
                continue
            self._make_room(stack, tag)
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack.nodes[-1])
            chrome, self.named[node], main = self._kind(tag, found["rest"])
            self.chrome.append(chrome)
            self.main.append(main)
            self.events.append((node, None))
            if tag in VOID or found["rest"].endswith("/") and tag in ("svg", "path"):
                self.events.append((-node - 1, None))
            elif tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                self.events.append((-node - 1, None))
                at = stop.end() if stop else end
            else:
                stack.push(node, tag)
        stack.cut(1)

    @staticmethod
    def _close(stack: Stack, tag: str) -> None:
        places = stack.of_tag.get(tag)
        # an inline end tag doesn't end blocks
        if places and (tag in BLOCK or not stack.blocks or stack.blocks[-1] < places[-1]):
            stack.cut(places[-1])

    @staticmethod
    def _make_room(stack: Stack, tag: str) -> None:
        closes, fence = CLOSES.get(tag), FENCE.get(tag, ())
        while closes:
            for k in reversed(stack.placed):
                open_tag = stack.tags[k]
                if open_tag in closes:
                    stack.cut(k)
                    break
                if open_tag in fence or open_tag in BLOCK and open_tag != "p" and not (tag in FENCE and open_tag not in FENCE[tag] and open_tag in ("p", "tr", "td", "th")):
                    return
            else:
                return

    def _kind(self, tag: str, attributes: str) -> tuple[bool, bool | None, bool]:
        """Whether an element goes by tag or role, and by its names (by a part of one: False), and whether it is the main one."""
        chrome, named, main = tag in CHROME_TAGS, None, tag in ("article", "main")
        if attributes and not attributes.isspace():
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" and value.lower() in ("", "hidden", "true"):
                    chrome = True
                elif name == "role":
                    chrome |= value.lower() in CHROME_ROLES
                    main |= value.lower() == "main"
                elif name == "itemprop":
                    main |= value.lower() == "articlebody"
                elif name == "style":
                    chrome |= bool(_HIDDEN.search(value))
                elif name in ("class", "id") and tag not in ("html", "body"):
                    for name in value.split():
                        words = {w.lower() for w in _WORD.findall(name)}
                        if words & CHROME_WORDS:
                            named = named or words <= CHROME_WORDS | PLAIN_WORDS
                            if words & COMMENT_WORDS and words <= COMMENT_WORDS | PLAIN_WORDS:
                                self.comments.add(len(self.tags) - 1)
        return chrome, named, main

    def _measure(self) -> None:
        """Text, words, linked words and hash of every subtree, and what of it by its kind goes."""
        n = len(self.tags)
        parts: list[list[bytes]] = [[t.encode()] for t in self.tags]
        self.words, linked, holds_main = [0] * n, [0] * n, [False] * n
        in_link = [False] * n
        self.texts: dict[int, str] = {}
        for node in range(1, n):
            in_link[node] = in_link[self.parents[node]] or self.tags[node] == "a"
        for k, (node, text) in enumerate(self.events):
            if isinstance(text, str):
                plain = decoded(text)
                self.texts[k] = plain
                words = plain.split()
                self.words[node] += len(words)
                linked[node] += len(words) * in_link[node]
                if words:
                    parts[node].append(b"t" + " ".join(words).encode("utf-8", "surrogatepass"))
            elif node < 0:
                own = -node - 1
                digest = hashlib.blake2b(b"\x1f".join(parts[own]), digest_size=8).digest()
                parts[own] = [digest]
                parts[self.parents[own]].append(digest)
        self.hashes = [int.from_bytes(p[0], "little", signed=True) if len(p[0]) == 8 and len(p) == 1 else 0 for p in parts]
        in_comments = [False] * n
        for node in range(1, n):
            in_comments[node] = in_comments[self.parents[node]] or node in self.comments
            self.main[node] = self.main[node] and not in_comments[node]
        unlinked = [w - k for w, k in zip(self.words, linked, strict=True)]
        for node in range(n - 1, 0, -1):
            up = self.parents[node]
            self.words[up] += self.words[node]
            linked[up] += linked[node]
            if self.tags[node] not in CHROME_TAGS and node not in self.comments:
                unlinked[up] += unlinked[node]
            holds_main[up] = holds_main[up] or holds_main[node] or self.main[node]
        self.linked = linked
        self.holds_main = holds_main
        bulk = set() if any(self.main) else self._bulk(unlinked)
        within = [False] * n
        for node in range(1, n):
            up = self.parents[node]
            within[node] = self.main[node] or within[up]
            spared = holds_main[node] or self.main[node] or node in bulk
            if self.tags[node] == "form":
                self.chrome[node] |= not spared
            if node in self.comments:
                self.chrome[node] |= not holds_main[node]
            elif self.named.get(node) is not None and self.tags[node] not in CHROME_TAGS:
                self.chrome[node] |= not spared and (self.named[node] or 2 * linked[node] > self.words[node] > 0)
        gone = [False] * n
        for node in range(1, n):
            up = self.parents[node]
            header = self.tags[node] == "header" and not within[up] and not holds_main[node]
            gone[node] = gone[up] or self.chrome[node] or header
        self.within, self.gone = within, gone
        content = [self.hashes[k] for k in range(1, n) if self.main[k] and not gone[k]]
        self.has_main = bool(content)
        self.content = content[0] if content else hash64("".join(self.texts.values()))

    def _bulk(self, unlinked: list[int]) -> set[int]:
        """The elements from the top down that each hold more than half of the unlinked words of the one above."""
        largest = [0] * len(self.tags)
        for node in range(1, len(self.tags)):
            up = self.parents[node]
            if self.tags[node] not in CHROME_TAGS and node not in self.comments and (not largest[up] or unlinked[node] > unlinked[largest[up]]):
                largest[up] = node
        found, at = set(), 0
        while largest[at] and 2 * unlinked[largest[at]] > unlinked[at]:
            at = largest[at]
            found.add(at)
        return found

    def may_be_template(self, node: int) -> bool:
        """Whether this block may be deleted as a template."""
        tag = self.tags[node]
        if not self.words[node] or tag not in BLOCK or tag in ("html", "body", "article", "main") or self.main[node] or self.holds_main[node]:
            return False
        return not self.within[node] or tag in CONTAINERS

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees that may be templates, told apart by what they need to be one."""
        return {self.key(node) for node in range(1, len(self.tags)) if self.may_be_template(node)}

    def key(self, node: int) -> int:
        """The hash of a subtree; its last bit is set where LONG_PAGES pages make it a template."""
        long = self.within[node] and self.words[node] > BOILER_WORDS and self.linked[node] <= LINK_SHARE * self.words[node]
        return self.hashes[node] & -2 | long

    def text(self, templates=frozenset()) -> str:
        """The main text without these subtrees, and without what goes by the rules."""
        gone = list(self.gone)
        if templates:
            for node in range(1, len(self.tags)):
                gone[node] = gone[node] or gone[self.parents[node]] or self.may_be_template(node) and self.key(node) in templates
        blocks, block = [], []
        for k, (node, text) in enumerate(self.events):
            if isinstance(text, str):
                if not gone[node] and (self.within[node] or not self.has_main):
                    block.append(self.texts[k])
                continue
            tag = self.tags[node if node >= 0 else -node - 1]
            if tag in BLOCK:
                blocks.append("".join(block))
                block = []
            elif tag in ("br", "td", "th", "img"):
                block.append(" ")
        blocks.append("".join(block))
        joined = (" ".join(b.split()) for b in blocks)
        return "\n".join(b for b in joined if b)


class Templates:
    """Membership of (host, subtree) in a sorted array of their joint hashes."""

    def __init__(self, keys: np.ndarray, host: int):
        self.keys, self.host = keys, host

    def __contains__(self, subtree: int) -> bool:
        key = joint(self.host, subtree)
        at = int(np.searchsorted(self.keys, key))
        return at < len(self.keys) and int(self.keys[at]) == key


def joint(host: int, subtree: int) -> int:
    """A signed 64-bit hash of a host's hash and a subtree's, the last bit of which stays."""
    return mix_int(host ^ mix_int(subtree)) & -2 | subtree & 1


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the hash of the url's host."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    return pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), F.xxhash64(host).alias("host"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, long_pages: int = LONG_PAGES) -> DataFrame:
    """(subtree, pages): the joint hashes of hosts and their templates, with the number of different pages that hold each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        contents, subtrees = [], []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(source)
            found = page.subtrees()
            contents += [page.content] * len(found)
            subtrees += [joint(host, x) for x in found]
        return pa.RecordBatch.from_arrays([pa.array(subtrees, pa.int64()), pa.array(contents, pa.int64())], ["subtree", "content"])

    rows = map_batches(pages.select("host", "html"), run, "subtree long, content long")
    counted = rows.distinct().groupBy("subtree").agg(F.count("*").alias("pages"))
    return stored(counted.filter(F.col("pages") >= F.when(F.col("subtree").bitwiseAND(1) == 1, long_pages).otherwise(min_pages)))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, long_pages: int = LONG_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    own = with_host(pages)
    found = templates(own, min_pages, long_pages).select("subtree")
    keys = None
    if found.count() <= broadcast_rows:
        keys = pages.sparkSession.sparkContext.broadcast(np.sort(found.toPandas()["subtree"].to_numpy(np.int64)))
        own = own.withColumn("templates", F.lit(None).cast("array<long>"))
    else:
        own = with_templates(own, found)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for source, host, gone in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "templates")), strict=True):
            texts.append(Page(source).text(Templates(keys.value if keys else np.sort(np.array(gone or [], np.int64)), host)))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(own.select("page_id", "url", "html", "host", "templates"), run, "page_id long, url string, text string, n_chars long")


def with_templates(own: DataFrame, found: DataFrame) -> DataFrame:
    """own with the array of the templates that each page holds, by joins on hashes: for more templates than a broadcast may hold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, subtrees = [], []
        for key, host, source in zip(*(batch.column(c).to_pylist() for c in ("page_hash", "host", "html")), strict=True):
            own_subtrees = [joint(host, x) for x in Page(source).subtrees()]
            keys += [key] * len(own_subtrees)
            subtrees += own_subtrees
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(subtrees, pa.int64())], ["page_hash", "subtree"])

    own = own.withColumn("page_hash", F.xxhash64("host", "html"))
    # copies of a page hold the same templates
    rows = map_batches(own.select("page_hash", "host", "html"), run, "page_hash long, subtree long").distinct()
    lists = rows.join(found, "subtree", "left_semi").groupBy("page_hash").agg(F.collect_list("subtree").alias("templates"))
    return own.join(stored(lists), "page_hash", "left")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
