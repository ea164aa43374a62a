"""Pages of PDF files as structs, and the rules that make blocks of them.

A page is (document_id, page, blocks, n_images, ocr_text, tables): blocks of lines of spans as a layout parser gives
them, the text that a character recognizer read, and grids of cells. Parser and recognizer are functions that the caller
brings; the rules are expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import grid_text

# What begins a line of a list, how much larger a heading is, and the confidence of each kind of block.
LIST_MARKERS = ("-", "•", "*", "–", "—")
HEADING_SIZE = 1.25
IMAGE_TEXT = "Image depicting a diagram or figure relevant to the document content."
TEXT_CONFIDENCE, OCR_CONFIDENCE, TABLE_CONFIDENCE, IMAGE_CONFIDENCE = 1.0, 0.80, 0.95, 0.85

PAGE = (
    "document_id string, page int, blocks array<struct<bbox:array<double>,lines:array<struct<spans:array<struct<text:string,size:double>>>>>>, "
    "n_images int, ocr_text string, tables array<array<array<string>>>"
)
_EMPTY: dict = {"blocks": [], "n_images": 0, "ocr_text": None, "tables": []}


def pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """The pages of all files under ``path``, by ``parse``; a file that it fails on has none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = parse(content)
                except Exception:  # noqa: BLE001  the parser is the caller's, and one bad file must not end the job
                    found = []
                out += [{"document_id": name, "page": i + 1, **_EMPTY, **p} for i, p in enumerate(found)]
            yield pd.DataFrame(out, columns=["document_id", "page", *_EMPTY])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, PAGE)


def _line_text(line: Column) -> Column:
    return F.array_join(F.filter(F.transform(line["spans"], lambda s: F.trim(s["text"])), lambda t: t != ""), " ")


def _line_size(line: Column) -> Column:
    return F.array_max(F.transform(F.filter(line["spans"], lambda s: F.trim(s["text"]) != ""), lambda s: F.coalesce(s["size"], F.lit(0.0))))


def page_text(blocks: Column) -> Column:
    return F.trim(F.array_join(F.flatten(F.transform(blocks, lambda b: F.transform(b["lines"], _line_text))), "\n"))


def page_facts(rows: DataFrame) -> DataFrame:
    """``rows`` with has_text_layer, text_length, image_count and is_scanned."""
    n = F.length(page_text(F.col("blocks")))
    return rows.withColumns({"has_text_layer": n > 0, "text_length": n, "image_count": F.col("n_images"), "is_scanned": (n < 30) & (F.col("n_images") > 0)})


def _row(page: DataFrame, suffix: Column, kind: Column | str, text: Column, bbox: Column, source: str, confidence: float, order: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return page.select(
        "document_id", "page", F.concat(F.lit("p"), F.col("page").cast("string"), suffix).alias("block_id"), kind.alias("block_type"), text.alias("text"),
        bbox.cast("array<double>").alias("bbox"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), order.cast("int").alias("block_seq"),
    )


def text_blocks(rows: DataFrame) -> DataFrame:
    """Headings (much larger than the page's upper median), lists (half the lines marked) and paragraphs."""
    spans = F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["lines"], lambda x: x["spans"]))))
    sizes = F.array_sort(F.filter(F.transform(spans, lambda s: s["size"]), lambda x: x > 0))
    median = F.coalesce(F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")), F.lit(0.0))
    one = rows.withColumn("median", median).select("document_id", "page", "median", F.posexplode("blocks").alias("i", "b"))
    lines = F.filter(F.transform("b.lines", lambda x: F.struct(_line_text(x).alias("t"), _line_size(x).alias("s"))), lambda x: x["t"] != "")
    held = one.withColumn("lines", lines).where(F.size("lines") > 0)
    largest = F.array_max(F.transform("lines", lambda x: x["s"]))
    marked = F.size(F.filter("lines", lambda x: F.array_contains(F.array(*(F.startswith(x["t"], F.lit(m)) for m in LIST_MARKERS)), True)))
    kind = F.when((F.col("median") > 0) & (largest >= F.col("median") * HEADING_SIZE), "heading").when(marked >= F.size("lines") / 2, "list").otherwise("paragraph")
    text = F.array_join(F.transform("lines", lambda x: x["t"]), "\n")
    return _row(held, F.concat(F.lit("_b"), F.col("i").cast("string")), kind, text, F.col("b.bbox"), "text", TEXT_CONFIDENCE, F.col("i"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """All blocks of pages in reading order: text where there is a text layer, else what was recognized; tables; images."""
    facts = page_facts(rows)
    text = text_blocks(facts.where("has_text_layer"))
    none = F.lit(None)
    read = facts.where("NOT has_text_layer AND trim(coalesce(ocr_text, '')) <> ''")
    ocr = _row(read, F.lit("_ocr"), "paragraph", F.trim("ocr_text"), none, "ocr", OCR_CONFIDENCE, F.lit(0))
    grids = facts.select("document_id", "page", F.posexplode("tables").alias("i", "grid")).where(F.size("grid") > 0)
    tables = _row(grids, F.concat(F.lit("_t"), F.col("i").cast("string")), "table", grid_text(F.col("grid")), none, "table_extractor", TABLE_CONFIDENCE, 100_000 + F.col("i"))
    shown = facts.where("n_images > 0").select("document_id", "page", F.explode(F.sequence(F.lit(0), F.col("n_images") - 1)).alias("i"))
    images = _row(shown, F.concat(F.lit("_img"), F.col("i").cast("string")), "image", F.lit(IMAGE_TEXT), none, "vision", IMAGE_CONFIDENCE, 200_000 + F.col("i"))
    return text.unionByName(ocr).unionByName(tables).unionByName(images)
