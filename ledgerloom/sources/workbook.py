"""Cells of .xlsx files with the standard library (a zip of XML sheets), rows as they are met.

Numbers in a cell whose style is a date or time come out as yyyy-MM-dd, with HH:mm:ss if they hold a time, in the
1900 or the 1904 system as the workbook says; other cells as their text.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Workers get this module's functions by value: they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = "workbook string, sheet string, row_no int, cells array<string>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of the standard that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def date_styles(styles) -> set[int]:
    """Indexes of the cell styles that show dates or times, from the parsed style sheet."""
    if styles is None:
        return set()
    coded = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{MAIN}numFmt")}
    shows = lambda code: re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|general', "", code, flags=re.I), re.I) is not None
    cells = styles.find(f"{MAIN}cellXfs")
    formats = [int(x.get("numFmtId") or 0) for x in cells] if cells is not None else []
    return {i for i, f in enumerate(formats) if (shows(coded[f]) if f in coded else f in DATE_FORMATS)}


def serial_date(number: float, from_1904: bool) -> str:
    """The date, time or both of a serial number; the 1900 system counts a 29 February 1900 that never was."""
    seconds = round(number * 86400)
    days, rest = divmod(seconds, 86400)
    clock = str(dt.timedelta(seconds=rest)).rjust(8, "0")
    if not days and not from_1904:
        return clock
    first = dt.date(1904, 1, 1) if from_1904 else dt.date(1899, 12, 31) if days < 60 else dt.date(1899, 12, 30)
    return str(first + dt.timedelta(days=days)) + (f" {clock}" if rest else "")


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of a workbook's sheets."""
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in _part(book, "xl/_rels/workbook.xml.rels")}
    found = [(s.get("name"), links[s.get(LINK)]) for s in _part(book, "xl/workbook.xml").iter(f"{MAIN}sheet")]
    return [(name, target if target.startswith("xl/") else f"xl/{target}") for name, target in found]


def sheet_cells(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list]]:
    """(row number, cells) of one sheet; a row at a time is held."""
    shared = _part(book, "xl/sharedStrings.xml")
    strings = [_text(s) for s in shared] if shared is not None else []
    dated = date_styles(_part(book, "xl/styles.xml"))
    about = _part(book, "xl/workbook.xml").find(f"{MAIN}workbookPr")
    from_1904 = about is not None and about.get("date1904") in ("1", "true")
    number = 0
    with book.open(part) as xml:
        for _, row in ElementTree.iterparse(xml):
            if row.tag != f"{MAIN}row":
                continue
            number = int(row.get("r") or number + 1)
            cells: list = []
            for cell in row.iter(f"{MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value, kind = cell.find(f"{MAIN}v"), cell.get("t") or "n"
                if kind == "inlineStr":
                    cells[at] = _text(cell)
                elif value is not None and value.text is not None:
                    if kind == "s":
                        cells[at] = strings[int(value.text)]
                    elif kind == "n" and int(cell.get("s") or 0) in dated and float(value.text) >= 0:
                        cells[at] = serial_date(float(value.text), from_1904)
                    else:
                        cells[at] = value.text
            yield number, cells
            row.clear()


def sheet_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, content) of workbooks to ROWS."""
    for frame in frames:
        for file in frame.itertuples():
            book = zipfile.ZipFile(io.BytesIO(file.content))
            for name, part in sheet_parts(book):
                rows = [(file.path, name, number, cells) for number, cells in sheet_cells(book, part)]
                yield pd.DataFrame(rows, columns=["workbook", "sheet", "row_no", "cells"])


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str, part: str) -> None:
        self.path, self.sheet, self.part = path, sheet, part


class _SheetReader(DataSourceReader):
    def __init__(self, path: str, wanted: str | None) -> None:
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[_Sheet]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for file in sorted(f.path for f in found if f.is_file and f.path.endswith(".xlsx")):
            with store.open_input_file(file) as content, zipfile.ZipFile(content) as book:
                out += [_Sheet(file, name, part) for name, part in sheet_parts(book) if self.wanted in (None, name.strip().lower())]
        return out

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as content, zipfile.ZipFile(content) as book:
            for number, cells in sheet_cells(book, partition.part):
                yield partition.path, partition.sheet, number, cells


class WorkbookSource(DataSource):
    """spark.read.format("workbook").load(path): rows of .xlsx files, a partition per sheet; option sheet takes one sheet's name, case aside.

    The driver reads the names of the sheets, tasks read by range what they need of the file. path is a file or folder that
    pyarrow can open: an absolute path or a URI.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        wanted = self.options.get("sheet")
        return _SheetReader(self.options["path"], wanted and wanted.strip().lower())


def register(spark: SparkSession) -> None:
    """Make format("workbook") known to the session."""
    spark.dataSource.register(WorkbookSource)
