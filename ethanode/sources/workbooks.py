"""Workbooks (Office Open XML): sheets read as rows in the executors, and rows written as sheets.

Spark lists and reads the files, from any store it knows; a task unzips one file after another
and walks a sheet's XML cell by cell, so the driver sees column names only.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Namespaces of the format, and numbers of its built-in formats that show dates or times.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _xml(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _text(node) -> str:
    """The text of a string item: its runs, without phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in part.iter(f"{_MAIN}t"))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose format shows a date or a time."""
    styles = _xml(book, "xl/styles.xml")
    if styles is None:
        return set()
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(f"{_MAIN}numFmt")}
    cells = styles.find(f"{_MAIN}cellXfs")
    formats = [int(x.get("numFmtId", 0)) for x in (() if cells is None else cells)]
    return {i for i, f in enumerate(formats) if f in _DATE_FORMATS or re.search("[ymdhs]", own.get(f, ""), re.I)}


def moment(serial: float, from_1904: bool = False) -> str:
    """A date's serial number as `yyyy-MM-dd HH:mm:ss`; under one day, as `HH:mm:ss`."""
    if 0 <= serial < 1:
        return (dt.datetime(1900, 1, 1) + dt.timedelta(seconds=round(serial * 86400))).strftime("%H:%M:%S")
    # the format counts a 29th of February in 1900
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30 if serial >= 60 else 31)
    return (start + dt.timedelta(seconds=round(serial * 86400))).strftime("%Y-%m-%d %H:%M:%S")


def _column(reference: str) -> int:
    """The place from 0 of a cell such as `AB12`."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_names(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheets in their order, and the files that hold them."""
    links = {r.get("Id"): r.get("Target") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
    out = {}
    for s in _xml(book, "xl/workbook.xml").iter(f"{_MAIN}sheet"):
        target = links[s.get(_LINK)]
        out[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (the first where none is named; none where it is missing): texts, numbers as they are written, dates as in `moment`, empty cells null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = sheet_names(book)
        path = next(iter(names.values()), None) if sheet is None else names.get(sheet)
        if path is None:
            return
        items = _xml(book, "xl/sharedStrings.xml")
        shared = [_text(s) for s in (() if items is None else items)]
        dates = _date_styles(book)
        properties = _xml(book, "xl/workbook.xml").find(f"{_MAIN}workbookPr")
        from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        with book.open(path) as file:
            data = None
            for event, node in ElementTree.iterparse(file, ("start", "end")):
                if event == "start":
                    data = node if node.tag == f"{_MAIN}sheetData" else data
                    continue
                if node.tag != f"{_MAIN}row":
                    continue
                row: list[str | None] = []
                for cell in node.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    row[at] = _value(cell, shared, dates, from_1904)
                node.clear()
                if data is not None:
                    data.clear()  # of the rows read before, too
                yield row


def _value(cell, shared: list[str], dates: set[int], from_1904: bool) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return (None if inline is None else _text(inline)) or None
    if value is None or not value.text:
        return None
    if kind == "s":
        return shared[int(value.text)] or None
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind == "e":
        return None
    if kind == "n" and int(cell.get("s", 0)) in dates:
        return moment(float(value.text), from_1904)
    return value.text


def table_rows(content: bytes, sheet: str | None = None) -> Iterator[dict[str, str]]:
    """A sheet's rows under the names of its first one; empty cells and rows, and cells under no name, are left out; of columns of one name the first counts."""
    rows = sheet_rows(content, sheet)
    names = next(rows, [])
    for row in rows:
        out: dict[str, str] = {}
        for name, value in zip(names, row, strict=False):
            if name and value is not None:
                out.setdefault(name.strip(), value)
        if out:
            yield out


def sheet_cells(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """(path, cells) of files (path, content): a map of names to texts for each row of the sheet."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[list[tuple[str, str]]] = []
                for cells in table_rows(content.as_py(), sheet):
                    rows.append(list(cells.items()))
                    if len(rows) == 1_000:
                        yield _batch(path, rows)
                        rows = []
                yield _batch(path, rows)

    def _batch(path: str, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["path", "cells"])

    return files.select("path", "content").mapInArrow(read, "path string, cells map<string, string>")


def sheet_header(files: DataFrame, sheet: str | None = None) -> list[str]:
    """The names in the first rows of the sheets, in their order, those of the first file first."""

    def read(batches):
        for batch in batches:
            found = [[n.strip() for n in next(sheet_rows(c.as_py(), sheet), []) if n] for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["path", "names"])

    lists = files.select("path", "content").mapInArrow(read, "path string, names array<string>").groupBy("names").agg(F.min("path").alias("path"))
    return list(dict.fromkeys(n for r in lists.orderBy("path").collect() for n in r["names"]))


def sheet_table(files: DataFrame, sheet: str | None = None, columns: Sequence[str] | None = None, path_col: str | None = None) -> DataFrame:
    """The sheets of all files as one table of texts.

    Columns are those asked for or, without that, all that some file names, in order; a file
    without one has nulls there. `path_col` names a column for the file a row comes from.
    """
    rows = sheet_cells(files, sheet)
    columns = sheet_header(files, sheet) if columns is None else columns
    out = [F.col("path").alias(path_col)] if path_col else []
    return rows.select(*out, *[F.try_element_at("cells", F.lit(c)).alias(c) for c in columns])


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a workbook or of a folder's workbooks; each task reads whole files."""
    found = spark.read.format("binaryFile")
    if not path.endswith(".xlsx"):
        found = found.option("pathGlobFilter", "*.xlsx")
    return found.load(path).where("content is not null and not startswith(regexp_extract(path, '[^/]+$', 0), '~')").select("path", "content")


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, columns: Sequence[str] | None = None, path_col: str | None = None) -> DataFrame:
    return sheet_table(workbook_files(spark, path), sheet, columns, path_col)


# --- writing -------------------------------------------------------------------------------

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NS = "http://schemas.openxmlformats.org"


def _letters(at: int) -> str:
    out = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(at: int, row: int, value) -> str:
    if value is None:
        return ""
    where = f'{_letters(at)}{row}'
    if isinstance(value, bool):
        return f'<c r="{where}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{where}"><v>{value!r}</v></c>' if value == value and abs(value) != float("inf") else ""
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))  # not allowed in XML
    return f'<c r="{where}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook(sheets: dict[str, tuple[Sequence[str], Iterable[Sequence]]]) -> bytes:
    """A workbook's bytes: for each sheet the names of its columns and its rows; dates and all else but numbers and booleans as text."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="rId1" Type="{_NS}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{_NS}/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{_NS}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_NS}/package/2006/relationships">{links}</Relationships>')
        for i, (columns, rows) in enumerate(sheets.values()):
            with book.open(f"xl/worksheets/sheet{i + 1}.xml", "w") as sheet:
                sheet.write(f'{_HEAD}<worksheet xmlns="{_NS}/spreadsheetml/2006/main"><sheetData>'.encode())
                for n, row in enumerate(chain([columns], rows), 1):
                    sheet.write(f'<row r="{n}">{"".join(_cell(at, n, v) for at, v in enumerate(row))}</row>'.encode())
                sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def as_workbooks(df: DataFrame, file: str, sheet: str = "Sheet1", order: Sequence[str] = ()) -> DataFrame:
    """(path, content): one workbook for each value of the column `file`, its rows by `order`.

    For exports by episode or subject, so a file is one that a spreadsheet can open; its rows
    go into it as they come, and a task holds one batch of them and what is compressed. They
    are texts, numbers and booleans as they are, all else as text.
    """
    columns = [c for c in df.columns if c != file]
    plain = (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType)
    shown = df.select(F.col(file).cast("string").alias("__file"), *[F.col(c) if isinstance(df.schema[c].dataType, plain) and not isinstance(df.schema[c].dataType, T.DecimalType) else F.col(c).cast("string").alias(c) for c in columns])

    def write(batches):
        rows = (r for b in batches for part in _slices(b) for r in zip(*[c.to_pylist() for c in part.columns], strict=True))
        for path, own in groupby(rows, key=lambda r: r[0]):
            content = workbook({sheet: (columns, (r[1:] for r in own))})
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], names=["path", "content"])

    def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return (batch.slice(at, 1_000) for at in range(0, batch.num_rows, 1_000))

    placed = shown.repartition("__file").sortWithinPartitions("__file", *[F.col(c).asc_nulls_last() for c in order])
    return placed.mapInArrow(write, "path string, content binary")
