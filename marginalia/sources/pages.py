"""PDF files by an optional library, in Arrow batches: pages with labels and text, outline, attributes.

Without the library a source raises when it is used; everything downstream works on such rows from any origin. What can't be
read comes out as a row with an error, never silently.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PAGES = "path string, page int, label string, text string, error string"
OUTLINE = "path string, pos int, level int, title string, page int, error string"
ATTRIBUTES = "path string, title string, author string, pages int, error string"


def page_rows(pdf: object, most: int = 1 << 30) -> list[tuple]:
    """page, label, text, error of the first pages of an open file; a page without text has empty text."""
    labels, rows = list(pdf.page_labels), []
    for i, page in enumerate(pdf.pages[:most]):
        try:
            rows.append((i + 1, labels[i] if i < len(labels) else None, page.extract_text() or "", None))
        except Exception as e:  # noqa: BLE001
            rows.append((i + 1, labels[i] if i < len(labels) else None, None, f"page not readable: {e}"))
    return rows


def outline_rows(pdf: object, levels: int = 3) -> list[tuple]:
    """pos, level, title, page, error of an open file's outline, in order, down to so many levels. An entry without a destination
    is left out, those beneath it are not."""
    rows: list[tuple] = []

    def walk(entries: list, level: int) -> None:
        for entry in entries:
            if isinstance(entry, list):
                if level + 1 < levels:
                    walk(entry, level + 1)
                continue
            try:
                page = pdf.get_destination_page_number(entry)
            except Exception:  # noqa: BLE001
                page = None
            if page is not None and page >= 0:
                rows.append((len(rows) + 1, level, str(entry.title or ""), page + 1, None))

    walk(pdf.outline, 0)
    return rows


def attribute_rows(pdf: object) -> list[tuple]:
    """title, author, pages, error of an open file; attributes that are absent or blank are null."""
    meta = pdf.metadata
    text = lambda x: (str(x).strip() or None) if x is not None else None
    return [(text(getattr(meta, "title", None)), text(getattr(meta, "author", None)), len(pdf.pages), None)]


def _extract(files: DataFrame, schema: str, rows_of: Callable[[object], list[tuple]]) -> DataFrame:
    arrow = {"string": pa.string(), "int": pa.int32()}
    names, types = zip(*(x.split() for x in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the optional library pypdf") from e
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = rows_of(PdfReader(io.BytesIO(data or b"")))
                except Exception as e:  # noqa: BLE001
                    rows = [(*[None] * (len(names) - 2), f"file not readable: {e}")]
                cols = list(zip(*[(path, *r) for r in rows])) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), arrow[t]) for c, t in zip(cols, types)], list(names))

    return files.select("path", "content").mapInArrow(run, schema)


def extract_pages(files: DataFrame, most: int = 1 << 30) -> DataFrame:
    """path, page, label, text, error of the first pages of PDF files (path, content)."""
    return _extract(files, PAGES, lambda pdf: page_rows(pdf, most))


def extract_outline(files: DataFrame) -> DataFrame:
    """path, pos, level, title, page, error of the outlines of PDF files (path, content), three levels deep."""
    return _extract(files, OUTLINE, outline_rows)


def extract_attributes(files: DataFrame) -> DataFrame:
    """path, title, author, pages, error of PDF files (path, content)."""
    return _extract(files, ATTRIBUTES, attribute_rows)
