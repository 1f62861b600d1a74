"""HTML extraction: subtrees that recur over a host's pages are deleted; what is left of the article is its text."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import stable

#: A subtree is template if at least so many different pages of its host have it, however many pages the host has.
MIN_PAGES = 3
#: Least share of the text that is left that articles have to hold to be all of it: one may be a teaser beside the text.
SHARE = 0.25
#: Parts into which the pages of one (host, subtree), and the copies of one page, are dealt.
SALTS, COPY_SALTS = 16, 4

# HTML elements by what they do to text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe map math menu nav noembed noframes noscript object script select style svg template textarea title video xmp".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements whose start ends an open element of these names, as far as the second set's elements.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of a class or id that mark what is no part of an article.
MARKS = frozenset("ad ads advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended related respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
#: Elements that can be template as a whole: containers anywhere, blocks of text only outside an article.
CONTAINERS = frozenset("address aside center details div dl fieldset figure footer form header menu nav ol section table ul".split())
TEXT_BLOCKS = frozenset("blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre".split())

#: The start of a comment or of character data, a declaration, or a tag; searched up to the last ">", so all find their end.
TOKEN = re.compile(r"""(<!--)|(<!\[CDATA\[)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^>]*+)>)""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "key", "parts", "dropped", "at")

    def __init__(self, tag: str, key: str, dropped: bool, at: int) -> None:
        self.tag, self.key, self.parts, self.dropped, self.at = tag, key, [], dropped, at


class Page:
    """One walk over a page: its blocks of text, and the hashes of its subtrees.

    Blocks are (text, place, marked): place 2 inside an article, 1 inside main, else 0; marked by HTML as no part of an
    article. Blocks of template subtrees are deleted whether marked or not. Time is in proportion to the page's length:
    open elements are found by name, and every search for an end is over what is left once at most.
    """

    def __init__(self, text: str, template: frozenset[int] | set[int] = frozenset()) -> None:
        self.template, self.subtrees, self.recurring = template, set(), 0
        self.blocks: list[tuple[str, int, bool]] = []
        self.held: tuple[list[str], list[str]] = ([], [])  # of a block: what stays, what is marked
        self.stack = [Node("", "", False, 0)]
        self.where: defaultdict[str, list[int]] = defaultdict(list)  # places of open elements in the stack
        self.walls = [0]  # those of blocks
        self.dropping = 0
        self._walk(text)
        while len(self.stack) > 1:
            self._close()
        self._flush()
        self.body = self._hash(self.stack[0])

    def _walk(self, text: str) -> None:
        at, end = 0, text.rfind(">") + 1
        data = "]]>" in text
        while m := TOKEN.search(text, at, end):
            self._text(text[at : m.start()])
            at = m.end()
            if m[1]:
                at = text.find("-->", at) + 3
                if at < 3:
                    return
            elif m[2]:
                stop = text.find("]]>", at) if data else -1
                data = stop >= 0
                at = stop + 3 if data else text.find(">", at) + 1
            elif name := m[4]:
                tag = name.lower()
                if m[3]:
                    self._end(tag)
                else:
                    self._start(tag, m[5] or m[6] or "")
                    if tag in RAW:
                        stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
                        at = stop.start() if stop else len(text)
        self._text(text[at:].partition("<!--")[0])

    def _text(self, text: str) -> None:
        if text:
            text = html.unescape(text)
            self.stack[-1].parts.append(" ".join(text.split()))
            self.held[self.dropping > 0].append(text)

    def _place(self) -> int:
        return 2 if self.where["article"] else 1 if self.where["main"] else 0

    def _flush(self) -> None:
        for marked, held in enumerate(self.held):
            if held:
                if text := " ".join("".join(held).split()):
                    self.blocks.append((text, self._place(), bool(marked)))
                held.clear()

    def _hash(self, node: Node) -> int:
        return xxhash.xxh3_64_intdigest("\x1f".join((node.key, *node.parts)).encode("utf-8", "surrogatepass")) - (1 << 63)

    def _close(self) -> None:
        node = self.stack[-1]
        if node.tag in BLOCKS:
            self._flush()
            self.walls.pop()
        elif node.dropped:
            self.held[1].append(" ")
        self.stack.pop()
        self.where[node.tag].pop()
        self.dropping -= node.dropped
        mark = self._hash(node)
        self.stack[-1].parts.append(str(mark))
        if node.tag in CONTAINERS or (node.tag in TEXT_BLOCKS and not self._place()):
            self.subtrees.add(mark)
            if mark in self.template:
                self.recurring += len(self.blocks) - node.at
                del self.blocks[node.at :]

    def _nearest(self, names: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of these names; 0 if none is open."""
        return max((self.where[n][-1] for n in names if self.where[n]), default=0)

    def _close_from(self, place: int) -> None:
        while len(self.stack) > place:
            self._close()

    def _pop_to(self, names: set[str], scope: set[str] | frozenset[str]) -> None:
        """Closes the innermost element of these names, unless an element of the scope is nearer."""
        place = self._nearest(names)
        if place > self._nearest(scope):
            self._close_from(place)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            self._pop_to({"p"}, {"button", "caption", "table", "td", "th", "article", "section", "div", "body"})
        if tag in ENDS:
            self._pop_to(*ENDS[tag])
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self.held[self.dropping > 0].append(" ")
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        if tag in VOID:
            self.stack[-1].parts.append(tag)
            return
        dropped = self._drops(tag, found)
        self.where[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.walls.append(len(self.stack))
        self.stack.append(Node(tag, f"{tag} {found.get('class', '')}", dropped, len(self.blocks)))
        self.dropping += dropped

    def _drops(self, tag: str, found: dict[str, str]) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header" and not self._place():
            return True
        if not found or tag in ("html", "body"):
            return False
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
            return True
        if found.get("role", "").lower() in ROLES:
            return True
        words = {w.lower() for name in ("class", "id") for w in WORDS.findall(found.get(name, ""))}
        if tag in ("article", "main"):
            return bool(words & {"comment", "comments"})
        return bool(words & MARKS) or ("header" in words and not self._place() and tag in CONTAINERS)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.held[self.dropping > 0].append(" ")
        if self.where[tag] and (tag in BLOCKS or self.where[tag][-1] > self.walls[-1]):
            self._close_from(self.where[tag][-1])

    def text(self) -> str:
        """What is not marked: the blocks of the articles if they hold a SHARE of it, else also those of main if they do so together, else all."""
        left = [(text, place) for text, place, marked in self.blocks if not marked]
        enough = SHARE * sum(len(text) for text, _ in left)
        for least in (2, 1, 0):
            kept = [text for text, place in left if place >= least]
            if kept and sum(map(len, kept)) >= enough:
                return "\n\n".join(kept)
        return ""

    def marked(self) -> int:
        return sum(marked for _, _, marked in self.blocks)


def host_of(url: Column) -> Column:
    """A URL's host in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _page(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def template_of(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """For each page by host and content hash, the hashes of its template subtrees: (host, page, template array<long>).

    A subtree's pages are counted once for each different content. Pages without template have no row; an array holds
    subtrees of its own page only, so no row grows with its host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(text or "") for text in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array([x.body for x in found], pa.int64()), pa.array([list(x.subtrees) for x in found], pa.list_(pa.int64()))], names=["host", "page", "body", "marks"])

    parsed = pages.select(host_of(F.col("url")).alias("host"), _page("html").alias("page"), "html").mapInArrow(run, "host string, page long, body long, marks array<long>")
    seen = stable(parsed, "html-subtrees").select("host", "page", "body", F.explode("marks").alias("mark"))
    often = seen.select("host", "body", "mark").distinct().groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = often.select("host", "mark", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = seen.select("host", "page", "mark").distinct().withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(often, ["host", "mark", "salt"])
    return stable(met.groupBy("host", "page").agg(F.collect_set("mark").alias("template")), "html-template")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, recurring, marked for each row of pages (page_id, url, html).

    Template subtrees of the page's host are deleted first (`recurring` blocks), then of what is left that which HTML
    marks as no part of the article (`marked` blocks): navigation, headers, footers, asides, forms, scripts, notices,
    adverts, comments. Text blocks inside an article are never template. Null and empty html give empty text; a null url belongs to the host without name; repeated rows and
    null ids give rows of their own; an empty table an empty result. Other columns are not read.
    """
    template = template_of(pages, min_pages).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))))
    work = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), _page("html").alias("page"), F.pmod(F.xxhash64("page_id"), F.lit(COPY_SALTS)).cast("int").alias("salt"))
    work = work.join(template.hint("merge"), ["host", "page", "salt"], "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(h or "", set(t or ())) for h, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
            texts, counts = [p.text() for p in found], [[p.recurring for p in found], [p.marked() for p in found]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (map(len, texts), *counts))], names=["page_id", "url", "text", "n_chars", "recurring", "marked"])

    return work.mapInArrow(run, "page_id long, url string, text string, n_chars long, recurring long, marked long")


def op5(pages: DataFrame) -> DataFrame:
    return extract(pages)
