"""Presentations and workbooks as table functions over the bytes of files: one file at a time in a task, rows out."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from statistics import mean
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# What a block of a shape that is not read is called, marks before texts, and points that make a header.
NOT_READ = {"chart": "CHART (3)", "group": "GROUP (6)"}
IMAGE_MARK, NOTES_MARK = "[Image OCR]: ", "Speaker Notes: "
FIRST_ROW, ALL_BOLD, FILLED, LARGER, HEADER = 1, 2, 1, 2, 3

BLOCKS = "page long, block_seq long, block_id string, block_type string, text string, source string, confidence double"
SHEETS = "position int, sheet string, text string"


class Package:
    """The parts of an Office file and the relations between them."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> Element | None:
        return ElementTree.fromstring(self.zip.read(name)) if name in self.names else None

    def related(self, name: str) -> dict[str, tuple[str, str]]:
        """(kind, part) by relation id; kinds are the last words of their addresses."""
        folder, base = posixpath.split(name)
        found = self.xml(f"{folder}/_rels/{base}.rels")
        whole = lambda target: target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
        return {} if found is None else {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], whole(r.get("Target", ""))) for r in found}

    def listed(self, index: str, entries: str, pattern: str) -> list[tuple[Element | None, str]]:
        """(entry, part) in the order of the index part; parts by number where it names none."""
        top, related = self.xml(index), self.related(index)
        named = [] if top is None else [(e, related[e.get(f"{_R}id")][1]) for e in top.iter(entries) if e.get(f"{_R}id") in related]
        named = [(e, part) for e, part in named if part in self.names]
        if named:
            return named
        parts = sorted((n for n in self.names if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1])[0]))
        entry = [] if top is None else list(top.iter(entries))
        return [(entry[i] if i < len(entry) else None, part) for i, part in enumerate(parts)]


def _lines(shape: Element) -> list[str]:
    return [t for p in shape.iter(f"{_A}p") if (t := "".join(r.text or "" for r in p.iter(f"{_A}t")).strip())]


def header_score(rows: list[list[Element]], flagged: bool) -> int:
    """Points of a table's first row: flagged, all cells bold, most of them filled, letters larger than the second row's."""
    first = rows[0]
    runs = lambda cell: [r for r in cell.iter(f"{_A}rPr")]
    sizes = lambda cells: [int(r.get("sz")) for c in cells for r in runs(c) if r.get("sz")]
    score = FIRST_ROW * flagged
    if first:
        score += ALL_BOLD * all(any(r.get("b") in ("1", "true") for r in runs(c)) for c in first)
        filled = sum(c.find(f"{_A}tcPr/{_A}solidFill") is not None for c in first)
        score += FILLED * (filled > len(first) / 2)
    here, below = sizes(first), sizes(rows[1]) if len(rows) > 1 else []
    return score + LARGER * bool(here and below and mean(here) > mean(below))


def table_lines(table: Element) -> str:
    """A table's text: between bars with a header, else with two spaces between cells."""
    rows = [list(r.findall(f"{_A}tc")) for r in table.findall(f"{_A}tr")]
    if not rows:
        return ""
    flag = table.find(f"{_A}tblPr")
    header = header_score(rows, flag is not None and flag.get("firstRow") in ("1", "true")) >= HEADER
    texts = [["\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in c.iter(f"{_A}p")).strip() for c in r] for r in rows]
    return "\n".join(f"| {' | '.join(r)} |" if header else "  ".join(r) for r in texts)


def _place(shape: Element) -> tuple[int, int]:
    off = shape.find(f".//{_A}off")
    return (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)


def _is_title(shape: Element) -> bool:
    mark = shape.find(f".//{_P}ph")
    return shape.tag == f"{_P}sp" and mark is not None and mark.get("type", "") in ("title", "ctrTitle")


def _name(shape: Element) -> str:
    found = shape.find(f".//{_P}cNvPr")
    return "" if found is None else found.get("name", "")


def _block(shape: Element, related: dict, package: Package, recognize: Callable[[bytes], str] | None) -> tuple | None:
    """(suffix of the id, block_type, text, source, confidence) of a shape; null where it says nothing."""
    if shape.tag == f"{_P}sp":
        lines = _lines(shape)
        return ("sh", "paragraph" if len(lines) == 1 else "list", "\n".join(lines), "pptx_native", 1.0) if lines else None
    if shape.tag == f"{_P}graphicFrame":
        if (table := shape.find(f".//{_A}tbl")) is not None:
            text = table_lines(table)
            return ("tbl", "table", text, "pptx_native", 1.0) if text else None
        return ("vis", "unparsed", f"Visual content: {_name(shape)} ({NOT_READ['chart']})", "pptx_native", 0.5)
    if shape.tag == f"{_P}grpSp":
        return ("vis", "unparsed", f"Visual content: {_name(shape)} ({NOT_READ['group']})", "pptx_native", 0.5)
    if shape.tag == f"{_P}pic" and recognize:
        blip = shape.find(f".//{_A}blip")
        part = related.get(blip.get(f"{_R}embed") if blip is not None else None, ("", ""))[1]
        text = recognize(package.zip.read(part)).strip() if part in package.names else ""
        return ("img", "paragraph", IMAGE_MARK + text, "pptx_ocr", 0.8) if text else None
    return None


def slide_blocks(data: bytes, recognize: Callable[[bytes], str] | None = None) -> Iterator[tuple]:
    """``BLOCKS`` rows of a presentation: by slide, the title, then shapes by place, then the speaker's notes."""
    package = Package(data)
    for page, (_, part) in enumerate(package.listed("ppt/presentation.xml", f"{_P}sldId", r"ppt/slides/slide\d+\.xml"), 1):
        slide, related = package.xml(part), package.related(part)
        tree = slide.find(f".//{_P}spTree")
        shapes = [s for s in (slide if tree is None else tree) if s.tag in (f"{_P}sp", f"{_P}graphicFrame", f"{_P}grpSp", f"{_P}pic")]
        title = next((s for s in shapes if _is_title(s)), None)
        found = []
        if title is not None and (lines := _lines(title)):
            found.append((f"s{page}_title", "heading", "\n".join(lines), "pptx_native", 1.0))
        for i, shape in enumerate(sorted((s for s in shapes if s is not title), key=_place)):
            if block := _block(shape, related, package, recognize):
                kind, *rest = block
                found.append((f"s{page}_sh{i}_vis" if kind == "vis" else f"s{page}_{kind}{i}", *rest))
        for kind, name in related.values():
            notes = package.xml(name) if kind == "notesSlide" else None
            body = [] if notes is None else [s for s in notes.iter(f"{_P}sp") if (m := s.find(f".//{_P}ph")) is not None and m.get("type") == "body"]
            if text := "\n".join(line for s in body for line in _lines(s)):
                found.append((f"s{page}_notes", "paragraph", NOTES_MARK + text, "pptx_native_notes", 1.0))
        yield from ((page, seq, *block) for seq, block in enumerate(found))


def _cell(c: Element, shared: list[str]) -> str:
    value = c.find(f"{_S}v")
    if c.get("t") == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    text = (value.text or "") if value is not None else ""
    return shared[int(text)] if c.get("t") == "s" and text else text


def _column(reference: str | None, after: int) -> int:
    """The number of the column in a reference such as AB7; the next one without a reference."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return after
    n = 0
    for x in letters[0]:
        n = n * 26 + ord(x) - 64
    return n - 1


def sheet_texts(data: bytes) -> Iterator[tuple[int, str, str]]:
    """``SHEETS`` rows of a workbook, in its own order; cells stand in their columns, empty ones between them stay."""
    package = Package(data)
    strings = package.xml("xl/sharedStrings.xml")
    shared = [] if strings is None else ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in strings.iter(f"{_S}si")]
    for position, (entry, part) in enumerate(package.listed("xl/workbook.xml", f"{_S}sheet", r"xl/worksheets/sheet\d+\.xml")):
        lines = []
        for row in package.xml(part).iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                at = _column(c.get("r"), len(cells))
                cells += [""] * (at + 1 - len(cells))
                cells[at] = _cell(c, shared)
            lines.append(",".join('"' + x.replace('"', '""') + '"' if re.search('[,"\n]', x) else x for x in cells))
        yield position, (entry.get("name") if entry is not None else None) or part.rsplit("/", 1)[-1].removesuffix(".xml"), "\n".join(lines)


def _table_function(parse: Callable[[bytes], Iterator[tuple]], ddl: str):
    class Rows:
        def eval(self, content: bytes):
            yield from parse(bytes(content))

    return F.udtf(Rows, returnType=ddl)


def _read(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], ddl: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.lateralJoin(_table_function(parse, ddl)(F.col("content").outer())).drop("content")


def presentations(spark: SparkSession, path: str, recognize: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, ``BLOCKS``) of all presentations under ``path``. ``recognize`` reads the text of a picture; without it pictures have none."""
    return _read(spark, path, lambda data: slide_blocks(data, recognize), BLOCKS)


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, ``SHEETS``) of all workbooks under ``path``: each sheet as CSV text."""
    return _read(spark, path, sheet_texts, SHEETS)
