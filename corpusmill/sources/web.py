"""Web sources: routing, links, crawls and page blocks from (url, html) tables."""

from __future__ import annotations

import html as html_text
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CRAWL_PAGES, SITEMAP_PAGES


def route(url: Column, content_type: Column | None = None) -> Column:
    """What reads an address: the video host by name, then the answer's content type, then the path's suffix.

    An address whose content type is unknown (null) is told by its suffix; without a content type column all are.
    """
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    kind = F.lower(content_type) if content_type is not None else F.lit(None).cast("string")
    presentation = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
    return (
        F.when(~url.rlike("^https?://"), "rejected").when(url.contains("youtube.com") | url.contains("youtu.be"), "youtube")
        .when(kind.contains("application/pdf"), "pdf").when(kind.contains(presentation), "pptx").when(kind.contains("video/"), "video").when(kind.contains("text/html"), "web")
        .when(path.endswith(".pdf"), "pdf").when(path.rlike(r"\.pptx?$"), "pptx").when(path.rlike(r"\.(mp4|mkv)$"), "video").when(path.rlike(r"\.xlsx?$"), "excel").otherwise("web")
    )


def origin(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def bare(url: Column) -> Column:
    """Without fragment and closing slash."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def _without_dots(path: Column) -> Column:
    """A path without "." and ".." segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    up = lambda out: F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))
    walk = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == ".", out).when(x == "..", up(out)).otherwise(F.array_append(out, x)))
    return F.concat(F.array_join(walk, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolve(base: Column, href: Column) -> Column:
    """The absolute address of a link on the page ``base``."""
    site, plain = origin(base), F.regexp_replace(base, "[?#].*$", "")
    path = F.substring(plain, F.length(site) + 1, 1 << 30)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    target, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    return (
        F.when(href == "", base).when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), href))
        .when(target == "", F.when(rest.startswith("?"), F.concat(plain, rest)).otherwise(F.concat(F.regexp_replace(base, "#.*$", ""), rest)))
        .otherwise(F.concat(site, _without_dots(F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))), rest))
    )


#: The value of an anchor's address, in double, single or no quotes.
ANCHOR = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def internal_links(pages: DataFrame) -> DataFrame:
    """(url, link): distinct links of a page's anchors to other pages of its host, without fragments and closing slashes."""
    found = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("href"))
    href = F.trim(F.regexp_replace(F.regexp_replace("href", "^[\"']|[\"']$", ""), "&amp;", "&"))
    links = found.select("url", bare(resolve(F.col("url"), href)).alias("link"))
    host = lambda c: F.regexp_extract(c, "^https?://([^/?#]+)", 1)
    return links.where((host(F.col("link")) == host(F.col("url"))) & (F.col("link") != F.regexp_replace("url", "/+$", ""))).distinct()


def sitemap_links(sitemaps: DataFrame, most: int = SITEMAP_PAGES) -> DataFrame:
    """(sitemap, position, url): the first ``most`` addresses of each (url, xml), in order."""
    found = sitemaps.select(F.col("url").alias("sitemap"), F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("position", "url"))
    return found.where(F.col("position") < most).withColumn("url", F.regexp_replace("url", "&amp;", "&"))


def sitemap_pages(sitemaps: DataFrame, pages: DataFrame, most: int = SITEMAP_PAGES) -> DataFrame:
    """(sitemap, position, url, html) of the addresses of a sitemap that were fetched."""
    return sitemap_links(sitemaps, most).join(pages.select("url", "html"), "url").select("sitemap", "position", "url", "html")


def crawl(bases: DataFrame, pages: DataFrame, most: int = CRAWL_PAGES) -> DataFrame:
    """(base, url, depth): each base and its first linked pages by name, ``most`` in all, as far as they exist."""
    links = internal_links(bases.join(pages, "url").select("url", "html"))
    first = F.row_number().over(Window.partitionBy("url").orderBy("link"))
    near = links.withColumn("_n", first).where(F.col("_n") < most).select(F.col("url").alias("base"), F.col("link").alias("target"))
    have = pages.select(F.col("url").alias("found"), bare(F.col("url")).alias("target")).dropDuplicates(["target"])
    reached = near.join(have, "target").select("base", F.col("found").alias("url"), F.lit(1).alias("depth"))
    return bases.select(F.col("url").alias("base"), "url", F.lit(0).alias("depth")).unionByName(reached)


# Elements that never hold content, and what marks noise in an element's id or class.
DROPPED = ("nav", "footer", "aside", "header", "script", "style", "noscript", "iframe", "form", "svg", "canvas")
NOISE = "comment|cookie|popup|banner|sidebar|social|share|advert|promo"
_NOISE = re.compile(NOISE, re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_LEVELS = {f"h{i}": i for i in range(1, 7)}
_KINDS = {"p": "paragraph", "ul": "list", "ol": "list", "pre": "code_block", "code": "code_block", "table": "table", **dict.fromkeys(_LEVELS, "heading")}
#: Elements that end a paragraph that was left open.
_ENDS_PARAGRAPH = frozenset([*_KINDS, "div", "section", "article", "main", "blockquote", "li", "td", "th", "tr", "dl", "figure", "hr"]) - {"code"}
_LOOSE = frozenset(("div", "section", "article", "main", "body", "blockquote", "span", "figure", "dd"))  # their own text is a paragraph


class _Element:
    def __init__(self, tag: str, path: str, hidden: bool):
        self.tag, self.path, self.hidden = tag, path, hidden
        self.children: dict[str, int] = {}
        self.block: _Block | None = None


class _Block:
    def __init__(self, kind: str, tag: str, path: str):
        self.kind, self.tag, self.path = kind, tag, path
        self.text: list[str] = []
        self.rows: list[list[list[str]]] = []  # cells of a table, or items of a list
        self.open = False  # whether a cell or item takes the text

    def write(self, data: str) -> None:
        if self.kind in ("table", "list"):
            if self.open:
                self.rows[-1][-1].append(data)
        else:
            self.text.append(data)

    def result(self) -> str:
        if self.kind == "list":
            items = (_joined(cells[0]) for cells in self.rows if cells)
            return "\n".join(f"- {x}" for x in items if x)
        if self.kind == "table":
            return "\n".join("| " + " | ".join(map(_joined, cells)) + " |" for cells in self.rows if cells)
        return "".join(self.text).strip("\n") if self.tag == "pre" else _joined(self.text)


def _joined(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def normalized(text: str) -> str:
    text = html_text.unescape(unicodedata.normalize("NFKC", text)).replace("\xa0", " ")
    return re.sub(r"[ \t]+", " ", text).strip()


class _Reader(HTMLParser):
    """Blocks of one page, with the headings above them and their place among the elements.

    An element without an end ends with its parent; what is inside a dropped or noisy element is hidden.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, list[str], str]] = []
        self.heads: list[tuple[int, str]] = []
        self.open = [_Element("", "", False)]

    def _block(self) -> _Block | None:
        return next((e.block for e in reversed(self.open) if e.block), None)

    def _finish(self, element: _Element) -> None:
        block, element.block = element.block, None
        text = normalized(block.result()) if block else ""
        if not text:
            return
        if block.kind == "heading":
            level = _LEVELS[block.tag]
            while self.heads and self.heads[-1][0] >= level:
                self.heads.pop()
            self.heads.append((level, text))
        self.blocks.append((block.kind, text, [t for _, t in self.heads], block.path))

    def _close(self, n: int) -> None:
        while len(self.open) > n:
            self._finish(self.open.pop())

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_PARAGRAPH:
            at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == "p"), 0)
            if at and not any(e.tag in ("table", "button") for e in self.open[at:]):
                self._close(at)
        if tag in ("li", "tr", "td", "th") and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)
        parent = self.open[-1]
        n = parent.children.get(tag, 0)
        parent.children[tag] = n + 1
        if tag in _VOID:
            self.handle_data(" ")
            return
        noisy = any(k in ("id", "class") and v and _NOISE.search(v) for k, v in attrs)
        element = _Element(tag, f"{parent.path}/{tag}[{n}]".lstrip("/"), parent.hidden or tag in DROPPED or noisy)
        self.open.append(element)
        if element.hidden:
            return
        inside = self._block()
        if inside is None or inside.kind == "loose":
            if inside is not None and tag in _KINDS:
                self._finish_loose()
            if tag in _KINDS and not (tag == "code" and inside is not None):
                element.block = _Block(_KINDS[tag], tag, element.path)
        elif inside.kind == "table" and tag == "tr":
            inside.rows.append([])
        elif inside.kind == "table" and tag in ("td", "th"):
            inside.rows = inside.rows or [[]]
            inside.rows[-1].append([])
            inside.open = True
        elif inside.kind == "list" and tag == "li":
            if sum(e.tag in ("ul", "ol") for e in self.open) == 1 + sum(e.tag in ("ul", "ol") for e in self.open[: self._at(inside)]):
                inside.rows.append([[]])
            inside.open = True

    def _at(self, block: _Block) -> int:
        return next(i for i, e in enumerate(self.open) if e.block is block)

    def _finish_loose(self) -> None:
        for e in self.open:
            if e.block and e.block.kind == "loose":
                e.block.kind = "paragraph"
                self._finish(e)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            inside = self._block()
            if inside is not None and tag in ("td", "th", "li") and inside.kind in ("table", "list"):
                inside.open = False
            for e in self.open[at:]:
                if e.block and e.block.kind == "loose":
                    e.block.kind = "paragraph"
            self._close(at)

    def handle_data(self, data):
        element = self.open[-1]
        if element.hidden:
            return
        block = self._block()
        if block is None and data.strip() and any(e.tag in _LOOSE for e in self.open):
            owner = next(e for e in reversed(self.open) if e.tag in _LOOSE)
            block = owner.block = _Block("loose", owner.tag, owner.path)
        if block is not None:
            block.write(data)

    def finish(self) -> None:
        self._finish_loose()
        self._close(1)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        url, seq, kind, text, path, place = [], [], [], [], [], []
        for u, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reader = _Reader()
            reader.feed(html or "")
            reader.finish()
            for i, (k, t, p, d) in enumerate(reader.blocks):
                url.append(u), seq.append(i), kind.append(k), text.append(t), path.append(p), place.append(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(url, pa.string()), pa.array(seq, pa.int32()), *(pa.array(x, pa.string()) for x in (kind, text)), pa.array(path, pa.list_(pa.string())), pa.array(place, pa.string())],
            ["url", "block_seq", "block_type", "text", "heading_path", "dom_path"],
        )


def page_blocks(pages: DataFrame) -> DataFrame:
    """(url, block_seq, block_type, text, heading_path, dom_path) of each page's content."""
    return pages.select("url", "html").mapInArrow(_read, "url string, block_seq int, block_type string, text string, heading_path array<string>, dom_path string")


def extraction(html_chars: Column, text_chars: Column) -> Column:
    """How an extraction counts: "primary" if dense and long, "readability" if long enough, else "error"."""
    dense = (text_chars / F.greatest(html_chars, F.lit(1)) > 0.02) & (text_chars > 500)
    return F.when(dense, "primary").when(text_chars >= 300, "readability").otherwise("error")


def confidence(block_type: Column, text: Column, dom_path: Column, method: Column, density: Column) -> Column:
    """How far a block can be trusted: by method, kind, length, depth and the density of its page."""
    score = (
        F.when(method == "readability", 0.9).otherwise(1.0)
        * F.when((block_type == "paragraph") & (F.length(text) < 80), 0.75).otherwise(1.0)
        * F.when(block_type == "code_block", 1.05).otherwise(1.0)
        * F.when(F.regexp_count(dom_path, F.lit("/")) > 10, 0.85).otherwise(1.0)
        * F.least(F.lit(1.0), density * 10)
    )
    return F.round(F.greatest(F.lit(0.1), F.least(score, F.lit(1.0))), 2)


def scored_blocks(pages: DataFrame) -> DataFrame:
    """The blocks of pages that pass the extraction gate, with method and confidence_score."""
    blocks = page_blocks(pages)
    sizes = blocks.groupBy("url").agg(F.sum(F.length("text") + 1).alias("text_chars")).join(pages.select("url", F.length("html").alias("html_chars")), "url")
    judged = sizes.withColumn("method", extraction(F.col("html_chars"), F.col("text_chars"))).where("method <> 'error'")
    density = F.col("text_chars") / F.greatest(F.col("html_chars"), F.lit(1))
    score = confidence(F.col("block_type"), F.col("text"), F.col("dom_path"), F.col("method"), density)
    return blocks.join(judged, "url").withColumn("confidence_score", score).drop("text_chars", "html_chars")
