"""Spreadsheets as tables, read with the standard library alone from any store that
Spark reads; the style sheet, which is malformed in some exports, is never opened."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from workrisk.operators.validation import IngestError

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PROVENANCE = ("source_row", "source_file", "source_sheet", "ingested_at")


def sheet_names(path: str | BinaryIO) -> list[str]:
    with zipfile.ZipFile(path) as book:
        return [name for name, _ in _sheets(book)]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and parts of all sheets, in order."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in links}
    out = []
    for sheet in root.iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(_REL)].lstrip("/")
        out.append((sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return out


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def read_rows(path: str | BinaryIO, sheet: int | str = 0) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number from 1, column -> text) of the rows that hold something, one
    row in memory at a time."""
    with zipfile.ZipFile(path) as book:
        sheets = _sheets(book)
        part = dict(sheets)[sheet] if isinstance(sheet, str) else sheets[sheet][1]
        shared = _shared(book)
        with book.open(part) as source:
            row_number = 0
            for _, row in ElementTree.iterparse(source):
                if row.tag != f"{_MAIN}row":
                    continue
                row_number = int(row.get("r") or row_number + 1)
                cells: dict[int, str] = {}
                for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                    if text != "":
                        cells[at] = text
                row.clear()
                if cells:
                    yield row_number, cells


#: Rows of a workbook that are handed on at once.
ROWS = 5000


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a workbook, or of all in a folder, in any store that
    Spark reads. A file is one row and so one task: its parts are compressed."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
        if not found.select("path").isEmpty():
            return found
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    raise IngestError(f"no workbook at {path}")


def read_workbook(spark: SparkSession, path: str, header_row: int = 1, sheet: int | str = 0) -> DataFrame:
    """All cells as strings, with where each row came from. Names come from the
    header row (the second one unless told otherwise) of the first file; rows
    before it are left out."""
    header = header_row + 1
    files = _files(spark, path)

    def names_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for number, cells in read_rows(io.BytesIO(content.as_buffer()), sheet):
                    if number == header:
                        yield pa.RecordBatch.from_arrays([pa.array([[cells.get(k, f"column_{k}").strip() for k in range(max(cells) + 1)]])], ["names"])
                        break

    first = files.orderBy("path").limit(1).mapInArrow(names_of, "names array<string>").head()
    if first is None:
        raise IngestError(f"{path}: no header in row {header}")
    names, width = [*first.names, *PROVENANCE], len(first.names)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                book = io.BytesIO(content.as_buffer())
                name = sheet if isinstance(sheet, str) else sheet_names(book)[sheet]
                rows = ((*[cells.get(k) for k in range(width)], str(number), where.rpartition("/")[2], name, now) for number, cells in read_rows(book, sheet) if number > header)
                while part := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part, strict=True)], names)

    return files.mapInArrow(rows_of, StructType([StructField(n, StringType()) for n in names]))


def write_workbook(path: str, rows: list[list], sheet: str = "Sheet1") -> None:
    """A small workbook of inline strings, for fixtures and hand-outs."""
    from xml.sax.saxutils import escape

    def name(k: int) -> str:
        out = ""
        k += 1
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    body = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{name(k)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for k, v in enumerate(row) if v is not None) + "</row>"
        for i, row in enumerate(rows, 1)
    )
    main = _MAIN.strip("{}")
    rel = _REL[1:].partition("}")[0]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
