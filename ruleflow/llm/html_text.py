"""Main text of web pages by deducing the template of each host from equivalence classes of tokens.

A page is cut into blocks of text, each under the path of its elements. A token is such a path, or a text
that stands under a path. Tokens of one host that occur equally often in the same pages share an
occurrence vector and form an equivalence class. A class is valid if it is in several pages; the class of
a token's parent path is the class that it is nested in. Nested valid classes are the template, texts among
their tokens are template text, and the paths with other text are its slots. Slots are judged once for the
host, by how much their text varies and how much of it is links; that they are in an article or main element
speaks for them and is outweighed by both together. Template text goes, in these elements too, unless it
is nearly all that its pages have: then they are copies of one article. Elements of another use (menus, forms)
are left out as such, and paths of too few pages to tell are judged by the page itself.

Vectors are never gathered: a token's vector is known by a digest over its pages, which aggregates like a
sum. Only counts by host and path are shuffled, and a host with most of the pages is pre-aggregated.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleflow.llm.blocks import text_blocks
from ruleflow.storage import Scratch, materialize

# A class must be in so many pages of its host to be valid.
MIN_PAGES = 3
# Of a slot whose elements say nothing: the least share of different texts, and the largest share of link text.
VARIED, MOST_LINKS = 0.5, 0.5
# Template text that makes up this share of the main text of its pages is the text of copied pages.
COPIED = 0.9
# The main element is taken instead of the articles in it if it has so many times their text.
MAIN_TO_ARTICLE = 2

# Elements and attribute words by their use.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr",
}
OUT = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "textarea",
    "input", "label", "iframe", "object", "embed", "svg", "math", "canvas", "audio", "video", "menu", "dialog", "title", "fieldset",
    "noembed", "noframes", "xmp",
}
# Elements that stand inside a line of text without ending it, though their own text is left out.
IN_LINE_OUT = {
    "script", "style", "noscript", "template", "button", "select", "label", "input", "textarea", "svg", "math", "object", "iframe", "video",
    "audio", "canvas", "embed", "option",
}
ARTICLE, MAIN = 2, 1
OUT_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar",
    "toolbar", "status",
}
OUT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar",
    "masthead", "footer", "comment", "comments", "respond", "reply", "replies", "disqus", "share", "sharing", "social", "related",
    "recommended", "widget", "login", "search", "skip",
}
# What makes an article element something else than the page's article.
OTHER_ARTICLES = {
    "ad", "ads", "advert", "comment", "comments", "promo", "recommended", "related", "replies", "reply", "respond", "sponsored",
}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story"}
# Elements that end an open one of the same group when they begin.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
KEEPS_OPEN = {"ul", "ol", "dl", "table", "menu", "select"}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<!--|<[!?]""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
NAME_PART = re.compile(r"[a-z0-9]+")


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


class Element:
    """An open element: name, how it is written in paths, and whether its text is left out or wanted."""

    __slots__ = ("name", "label", "out", "main", "header", "hinted")

    def __init__(self, name: str, source: str):
        given = attributes(source) if source.strip(" /") else {}
        classes = sorted(set(f"{given.get('class', '')} {given.get('id', '')}".lower().split()))
        parts = {part for word in classes for part in NAME_PART.findall(word)}
        role = given.get("role", "").lower()
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true"
        self.name = name
        self.label = ".".join([name, *[re.sub(r"\d+", "0", c).replace("/", "_") for c in classes]])
        self.header = name == "header" or "header" in parts
        self.hinted = bool(parts & MAIN_WORDS)
        if name == "article" or role == "article":
            self.out = hidden or bool(parts & OTHER_ARTICLES)
            self.main = 0 if self.out else ARTICLE
        else:
            self.main = MAIN if name == "main" or role == "main" else 0
            named = name in OUT or role in OUT_ROLES or hidden or bool(parts & OUT_WORDS)
            self.out = named and not self.main and name not in ("html", "body")


Block = tuple[str, str, int, bool, int, bool]


class Parser:
    """The blocks of a page and how often each path of elements begins.

    A block is (path, text, characters inside links, left out, level of the main element, hinted); ``hinted``
    says that an element is named like a container of main text. Character references are decoded and white
    space is one space. What no end tag closes ends with its parent; end tags of nothing are dropped.
    """

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.elements: Counter[str] = Counter()
        self.stack: list[Element] = []
        self.text: list[str] = []
        self.linked: list[str] = []
        place = 0
        while m := TAG.search(source, place):
            self.add(source[place : m.start()])
            place = m.end()
            if m[2] is None:  # a comment or declaration
                stop = "-->" if m[0] == "<!--" else ">"
                end = source.find(stop, place)
                place = len(source) if end < 0 else end + len(stop)
            elif m[1]:
                self.end(m[2].lower())
            else:
                place = self.start(m[2].lower(), m[3], source, place)
        self.add(source[place:])
        self.flush()

    def add(self, piece: str) -> None:
        if piece and not any(e.out and (e.name in INLINE or e.name in IN_LINE_OUT) for e in self.stack):
            self.text.append(piece)
            if any(e.name == "a" for e in self.stack):
                self.linked.append(piece)

    def flush(self) -> None:
        words = " ".join(html.unescape("".join(self.text)).split())
        if words:
            main = max((e.main for e in self.stack), default=0)
            out = any(e.out or (e.header and not main) for e in self.stack)
            outer = [e for e in self.stack if e.name not in INLINE]
            links = len(" ".join(html.unescape("".join(self.linked)).split()))
            path = "/".join(e.label for e in outer)
            self.blocks.append((path, words, links, out, 0 if out else main, any(e.hinted for e in outer)))
        self.text.clear()
        self.linked.clear()

    def start(self, name: str, source: str, page: str, place: int) -> int:
        """Opens an element; returns where the page goes on."""
        if name == "br":
            self.add(" ")
            return place
        if name not in INLINE and name not in IN_LINE_OUT:
            self.flush()
            self.close({"p"}, set())
            self.close(CLOSES.get(name, set()), KEEPS_OPEN)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, place)
            return len(page) if end is None else end.end()
        if name not in VOID and not (name in IN_LINE_OUT and source.endswith("/")):
            self.stack.append(Element(name, source))
            if name not in INLINE:
                self.elements["/".join(e.label for e in self.stack if e.name not in INLINE)] += 1
        return place

    def close(self, names: set[str], barriers: set[str]) -> None:
        """Ends the innermost open element of the names, and all inside it, if no barrier is inside it."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name in barriers:
                return
            if self.stack[i].name in names:
                del self.stack[i:]
                return

    def end(self, name: str) -> None:
        if name not in INLINE and name not in IN_LINE_OUT:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                if name in INLINE:
                    del self.stack[i]  # blocks that began inside it go on
                else:
                    del self.stack[i:]
                return


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


BLOCK = "struct<path: string, text: string, links: int, out: boolean, main: int, hinted: boolean, times: int>"
ELEMENT = "struct<path: string, times: int>"
PARSED = f"row long, page_id long, url string, host string, blocks array<{BLOCK}>, elements array<{ELEMENT}>"
BLOCK_TYPE = pa.list_(pa.struct([
    ("path", pa.string()), ("text", pa.string()), ("links", pa.int32()), ("out", pa.bool_()), ("main", pa.int32()), ("hinted", pa.bool_()),
    ("times", pa.int32()),
]))
ELEMENT_TYPE = pa.list_(pa.struct([("path", pa.string()), ("times", pa.int32())]))


def counted_blocks(blocks: list[Block]) -> list[dict]:
    """Blocks as rows; ``times`` is how often a block's path and text are in the page, 0 from their second place on."""
    counts = Counter(b[:2] for b in blocks)
    names = ("path", "text", "links", "out", "main", "hinted")
    return [dict(zip(names, b, strict=True)) | {"times": counts.pop(b[:2], 0)} for b in blocks]


def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches, "html"):
        pages = [Parser(source or "") for source in block.column("html").to_pylist()]
        found = [counted_blocks(p.blocks) for p in pages]
        elements = [[{"path": path, "times": n} for path, n in p.elements.items()] for p in pages]
        columns = [
            block.column("row"), block.column("page_id"), block.column("url"),
            pa.array([host_of(url) for url in block.column("url").to_pylist()]), pa.array(found, BLOCK_TYPE), pa.array(elements, ELEMENT_TYPE),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "page_id", "url", "host", "blocks", "elements"])


def parsed(pages: DataFrame) -> DataFrame:
    """``PARSED`` of every row; ``row`` tells pages apart in digests, repeated rows have the same."""
    given = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return given.select(F.xxhash64("page_id", "url", "html").alias("row"), "*").mapInArrow(parse, PARSED)


def digested(*more: str) -> Column:
    """Blocks that their elements don't leave out, with digests for texts, and the fields of ``more``."""
    return F.transform(
        F.filter("blocks", lambda b: ~b["out"]),
        lambda b: F.struct(
            b["path"].alias("path"), F.xxhash64(b["text"]).alias("digest"), F.length(b["text"]).alias("chars"), b["links"].alias("links"),
            b["main"].alias("main"), *(b[name].alias(name) for name in more),
        ),
    )


def outlines(pages: DataFrame) -> DataFrame:
    """``(host, row, elements, blocks, contents)`` of parsed pages: what templates are made from, with digests for texts.

    ``contents`` are digests of all text in no main element, in the main element, and in articles.
    """
    contents = F.array(*(
        F.xxhash64(F.transform(F.filter("blocks", lambda b, n=level: b["main"] == n), lambda b: b["digest"])) for level in (0, MAIN, ARTICLE)
    ))
    return pages.select("host", "row", "elements", digested("hinted", "times").alias("blocks")).withColumn("contents", contents)


def tokens(pages: DataFrame) -> DataFrame:
    """``(host, path, text, pages, vector)`` of outlines: elements by path (text NULL) and texts by path, by host.

    ``vector`` is a digest of the occurrence vector: of the pages and how often the token is in each. It is made of
    sums, so that repeated rows, which count as pages, don't cancel out; no sum passes 64 bits below 2^27 pages.
    """
    digest = F.xxhash64("row", F.col("times").cast("long"))
    sums = F.sum(digest.bitwiseAND(F.lit((1 << 36) - 1))), F.sum(F.shiftrightunsigned(digest, 28))
    vector = (F.count(F.lit(1)).alias("pages"), F.xxhash64(*sums).alias("vector"))
    elements = pages.select("host", "row", F.explode("elements").alias("e")).select("host", "row", "e.*")
    of_paths = elements.groupBy("host", "path").agg(*vector).withColumn("text", F.lit(None).cast("long"))
    blocks = pages.select("host", "row", F.explode("blocks").alias("b"))
    texts = blocks.select("host", "row", "b.path", F.col("b.digest").alias("text"), "b.times").filter("times > 0")
    return of_paths.unionByName(texts.groupBy("host", "path", "text").agg(*vector))


def templates(counted: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, vector, pages, elements, texts, nested_in)``: the classes of the template, as trees by host.

    A class is valid if it is in ``min_pages`` pages and nested: its shortest path is an outermost element or
    inside an element of a valid class with as many pages or more. ``nested_in`` is the vector of the
    nearest such class.
    """
    valid = counted.filter(F.col("pages") >= min_pages)
    classes = valid.groupBy("host", "pages", "vector").agg(
        F.sort_array(F.collect_set(F.when(F.col("text").isNull(), F.struct(F.length("path").alias("size"), "path")))).alias("elements"),
        F.collect_set(F.when(F.col("text").isNotNull(), F.struct("path", "text"))).alias("texts"),
        F.min(F.struct(F.length("path").alias("size"), "path"))["path"].alias("root"),
    )
    names = F.split("root", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.array_join(F.slice(names, 1, i), "/"))
    outer = valid.filter("text is null").select(
        "host", F.col("path").alias("above"), F.col("vector").alias("outer"), F.col("pages").alias("outer_pages")
    )
    inside = classes.select("host", "pages", "vector", F.explode(above).alias("above")).join(outer, ["host", "above"])
    nearest = (
        inside.filter((F.col("outer_pages") >= F.col("pages")) & (F.col("outer") != F.col("vector")))
        .groupBy("host", "pages", "vector").agg(F.max_by("outer", F.length("above")).alias("nested_in"))
    )
    nested = classes.join(nearest, ["host", "pages", "vector"], "left")
    return nested.filter(F.col("nested_in").isNotNull() | ~F.contains("root", F.lit("/"))).drop("root")


def slots(pages: DataFrame, template: DataFrame) -> DataFrame:
    """``(host, closed, open, fixed)``: one row per host, as long as its template.

    A slot is a path of the template that blocks of text stand in. ``closed`` slots hold no main text, as their
    text hardly varies or is links; ``open`` ones do. In an article or main element only both close a slot. Texts
    that equal pages repeat count once. ``fixed`` are template texts: those in a class with an element, so that
    they come exactly as often as it. Slots whose elements leave them out need no entry.
    """
    blocks = pages.select("host", "contents", F.explode("blocks").alias("b")).select("host", "contents", "b.*")
    content = F.element_at("contents", F.col("main") + 1)
    stated = blocks.groupBy("host", "path").agg(
        F.approx_count_distinct(F.xxhash64(content, "digest")).alias("placed"), F.approx_count_distinct("digest").alias("different"),
        F.sum("links").alias("links"), F.sum("chars").alias("chars"), F.bool_or("hinted").alias("hinted"), F.max("main").alias("main"),
    )
    paths = template.select("host", F.explode("elements.path").alias("path"))
    varies = F.col("different") >= VARIED * F.col("placed")
    unlinked = F.col("links") <= MOST_LINKS * F.col("chars")
    holds = F.when(F.col("main") > 0, varies | unlinked).otherwise((varies & unlinked) | F.col("hinted"))
    judged = stated.join(paths, ["host", "path"]).withColumn("holds", holds)
    by_host = judged.groupBy("host").agg(
        F.collect_set(F.when(~F.col("holds"), F.col("path"))).alias("closed"), F.collect_set(F.when(F.col("holds"), F.col("path"))).alias("open")
    )
    fixed = template.filter(F.size("elements") > 0).select("host", F.explode("texts").alias("t"))
    return by_host.join(fixed.groupBy("host").agg(F.collect_set("t").alias("fixed")), "host", "full")


def placed(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` with those of their ``blocks`` that are in slots with main text, and ``fixed`` in each for template text.

    Slots of the host decide; where it has not judged a path, links do outside main elements. Of a page with a
    main element, the blocks are those of its articles, or those outside them if they have far more text.
    """
    told = lambda name, value: F.coalesce(F.array_contains(name, value), F.lit(False))
    held = F.filter(
        "blocks",
        lambda b: ~told("closed", b["path"]) & ((b["main"] > 0) | told("open", b["path"]) | (b["links"] <= MOST_LINKS * b["chars"])),
    )
    chars = lambda level: F.aggregate(
        "blocks", F.lit(0).cast("long"), lambda n, b: n + F.when(b["main"] == level, b["chars"]).otherwise(0)
    )
    highest = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["main"])), F.lit(0))
    level = F.when((F.col("highest") == ARTICLE) & (chars(MAIN) > MAIN_TO_ARTICLE * chars(ARTICLE)), MAIN).otherwise(F.col("highest"))
    marked = F.transform(
        F.filter("blocks", lambda b: b["main"] == F.col("level")),
        lambda b: b.withField("fixed", told("fixed", F.struct(b["path"].alias("path"), b["digest"].alias("text")))),
    )
    joined = pages.withColumn("highest", highest).join(found, "host", "left")
    return joined.withColumn("blocks", held).withColumn("level", level).withColumn("blocks", marked)


def settled(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` without the template texts that are nearly all the main text of their pages: copies of one article."""
    chars = lambda blocks: F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + b["chars"])
    fixed = F.filter("blocks", lambda b: b["fixed"])
    given = pages.join(found.filter(F.size("fixed") > 0).select("host"), "host", "left_semi")
    marked = placed(given, found).select("host", fixed.alias("texts"), chars(fixed).alias("repeated"), chars("blocks").alias("chars"))
    texts = marked.select("host", "repeated", "chars", F.explode("texts").alias("b")).groupBy("host", "b.path", "b.digest")
    shares = texts.agg(F.sum("repeated").alias("repeated"), F.sum("chars").alias("chars")).filter(F.col("repeated") < COPIED * F.col("chars"))
    kept = shares.groupBy("host").agg(F.collect_set(F.struct("path", F.col("digest").alias("text"))).alias("fixed"))
    return found.drop("fixed").join(kept, "host", "left")


def chosen(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The text of each page: what its host's slots hold, without the text of the template."""
    given = pages.select("page_id", "url", "host", digested("text").alias("blocks"))
    wanted = F.filter("blocks", lambda b: ~b["fixed"])
    text = F.array_join(F.transform(wanted, lambda b: b["text"]), "\n\n")
    return placed(given, found).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    The blocks in the host's slots that hold main text, those of the article or the main element if there is one,
    without text of the host's template, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
    and comments, in page order, joined by two line breaks. A NULL or empty page, or one without such text,
    gives an empty text; a NULL or broken url is of the host ''; NULL ids and repeated rows stay; other
    columns are not read.
    """
    with Scratch(pages.sparkSession, "html-text") as scratch:
        stored = scratch.store(outlines(parsed(pages)), "outlines")
        template = scratch.store(templates(scratch.store(tokens(stored), "tokens"), min_pages), "template")
        found = materialize(settled(stored, scratch.store(slots(stored, template), "slots")), "html-slots")
    # Pages are parsed a second time, which costs less than storing all their text in between.
    return chosen(parsed(pages), found)
