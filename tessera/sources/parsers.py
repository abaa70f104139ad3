"""Parsers of binary office files, on the standard library alone.

Both formats are zip archives of XML.  PDF text, OCR and pictures need libraries that a deployment
plugs in through ``operators.hooks``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def column_number(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        n = n * 26 + ord(letter) - 64
    return max(n - 1, 0)


def workbook_rows(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet name, rows of cell texts) of an .xlsx file, in workbook order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            target = targets.get(sheet.get(RELATION), "").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            rows = []
            for row in ElementTree.fromstring(book.read(path)).iter(f"{SHEET}row") if path in names else ():
                cells: list[str] = []
                for cell in row.iter(f"{SHEET}c"):
                    at = column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [""] * (at - len(cells) + 1)
                    value = cell.find(f"{SHEET}v")
                    if cell.get("t") == "s" and value is not None:
                        cells[at] = shared[int(value.text)]
                    elif cell.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
                    else:
                        cells[at] = value.text or "" if value is not None else ""
                rows.append(cells)
            out.append((sheet.get("name", ""), rows))
        return out


def document_markdown(content: bytes) -> str:
    """The paragraphs and tables of a .docx file; heading styles become headings."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        body = ElementTree.fromstring(book.read("word/document.xml")).find(f"{WORD}body")
    out = []
    for block in body if body is not None else ():
        if block.tag == f"{WORD}p":
            text = "".join(t.text or "" for t in block.iter(f"{WORD}t")).strip()
            style = next((s.get(f"{WORD}val", "") for s in block.iter(f"{WORD}pStyle")), "")
            level = re.match(r"(?:Heading|heading ?)(\d)", style)
            if text:
                out.append(f"{'#' * int(level.group(1))} {text}" if level else text)
        elif block.tag == f"{WORD}tbl":
            for row in block.iter(f"{WORD}tr"):
                cells = ["".join(t.text or "" for t in c.iter(f"{WORD}t")).strip() for c in row.iter(f"{WORD}tc")]
                out.append("| " + " | ".join(cells) + " |")
    return "\n\n".join(out)


def sheets_of(files: DataFrame) -> DataFrame:
    """``files`` (path, content) of workbooks to (doc, sheet_no, sheet, rows); what cannot be read has
    no sheets."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file in frame.itertuples():
                try:
                    found = workbook_rows(file.content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    found = []
                rows += [(file.path, i, name, cells) for i, (name, cells) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc", "sheet_no", "sheet", "rows"])

    return files.select("path", "content").mapInPandas(run, "doc string, sheet_no int, sheet string, rows array<array<string>>")


def words_of(files: DataFrame) -> DataFrame:
    """``files`` (path, title, content) of .docx to (doc, text, error)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file in frame.itertuples():
                try:
                    text = document_markdown(file.content)
                    rows.append((file.path, f"# {file.title}\n\n{text}\n" if text else None, None if text else "empty document"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((file.path, None, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["doc", "text", "error"])

    return files.select("path", "title", "content").mapInPandas(run, "doc string, text string, error string")
