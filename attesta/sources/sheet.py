"""A spreadsheet as a Spark data source: format("sheet"), the first worksheet of .xlsx files.

A workbook is a zip of XML, read here with the standard library. Each file is one partition, so a folder of workbooks is read
in parallel. Columns: row_no, and the cells c1.. as STRUCT(text, hyperlink); the header row is skipped, rows without any cell
are not there. Numbers are text as they are written in the file; shared and inline strings are resolved.
"""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _targets(book: zipfile.ZipFile, name: str) -> dict[str, str]:
    if name not in book.namelist():
        return {}
    return {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read(name)).iter(f"{_P}Relationship")}


def read_sheet(path: str | IO[bytes], width: int) -> Iterator[tuple]:
    """(row_no, (text, hyperlink), ...) of the first worksheet, without its header."""
    with zipfile.ZipFile(path) as book:
        shared = [_texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_M}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_M}sheets/{_M}sheet").get(f"{_R}id")
        target = _targets(book, "xl/_rels/workbook.xml.rels")[first].lstrip("/")
        sheet = target if target.startswith("xl/") else f"xl/{target}"
        folder, file = os.path.split(sheet)
        outside = _targets(book, f"{folder}/_rels/{file}.rels")
        # Links stand behind the cells in the file, so they are read first.
        links = {}
        with book.open(sheet) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{_M}hyperlink":
                    links[e.get("ref")] = outside.get(e.get(f"{_R}id")) or e.get("location")
                elif e.tag == f"{_M}row":
                    e.clear()
        with book.open(sheet) as f:
            number = 0
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{_M}row":
                    continue
                number = int(e.get("r") or number + 1)
                cells: list[tuple | None] = [None] * width
                for k, c in enumerate(e.iter(f"{_M}c"), 1):
                    ref = c.get("r")
                    i = _column(ref) if ref else k
                    if i > width:
                        continue
                    v, kind = c.find(f"{_M}v"), c.get("t")
                    text = _texts(c) if kind == "inlineStr" else None if v is None or v.text is None else shared[int(v.text)] if kind == "s" else v.text
                    link = links.get(ref)
                    cells[i - 1] = None if text is None and link is None else (text, link)
                if number > 1 and any(cells):
                    yield (number, *cells)
                e.clear()


class SheetReader(DataSourceReader):
    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(f"{self.path}/*.xlsx")) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return read_sheet(partition.value, self.width)


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return ", ".join(["row_no int", *[f"c{i} struct<text:string,hyperlink:string>" for i in range(1, int(self.options.get("columns", 7)) + 1)]])

    def reader(self, schema) -> SheetReader:
        return SheetReader(self.options["path"], int(self.options.get("columns", 7)))


def sheets(spark: SparkSession, path: str, width: int) -> DataFrame:
    """The rows of the workbooks at `path`, in whatever file system Spark reads; a task reads its workbooks one by one."""
    cell = "struct<text:string,hyperlink:string>"
    schema = ", ".join(["row_no int", *[f"c{i} {cell}" for i in range(1, width + 1)]])

    def run(batches):
        for b in batches:
            for content in b["content"]:
                rows = [(r[0], *[None if c is None else {"text": c[0], "hyperlink": c[1]} for c in r[1:]]) for r in read_sheet(io.BytesIO(content), width)]
                yield pd.DataFrame(rows, columns=["row_no", *[f"c{i}" for i in range(1, width + 1)]])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content").mapInPandas(run, schema)


def registry_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The registry's seven columns of a workbook or a folder of workbooks; the last is where its cell points to."""
    from attesta.operators.registry import ATTRIBUTES, cell_link, cell_text

    rows = sheets(spark, path, 7)
    named = ["iis_no", *ATTRIBUTES]
    return rows.select("row_no", *[(cell_link if i == 7 else cell_text)(F.col(f"c{i}.text"), F.col(f"c{i}.hyperlink")).alias(n) for i, n in enumerate(named, 1)])
