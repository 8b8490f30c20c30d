"""Workbooks (.xlsx): rows of a sheet from binary files, and tables written as workbooks.

A workbook is a zip of XML files; tasks read the sheet as a stream of elements,
a workbook at a time, so many workbooks are read side by side and a task holds
one file and a batch of its rows. The format itself ends at 2**20 rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROWS_AT_ONCE = 10_000


def _text(element) -> str:
    """All runs of a string, but not its phonetic reading."""
    own = [t.text or "" for t in element.findall(f"{SPACE}t")]
    return "".join(own + [t.text or "" for r in element.findall(f"{SPACE}r") for t in r.findall(f"{SPACE}t")])


def _column(reference: str) -> int:
    number = 0
    for c in re.match("[A-Z]+", reference)[0]:
        number = 26 * number + ord(c) - 64
    return number - 1


def _rows(content: bytes, sheet: int) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells as text): empty cells are null, booleans 0 or 1, numbers as they are written."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(s) for s in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot().findall(f"{SPACE}si")]
        at, sheet_data = 0, None
        for event, row in ElementTree.iterparse(book.open(f"xl/worksheets/sheet{sheet}.xml"), ("start", "end")):
            if event == "start":
                sheet_data = row if row.tag == f"{SPACE}sheetData" else sheet_data
                continue
            if row.tag != f"{SPACE}row":
                continue
            at = int(row.get("r", at + 1))
            cells: list[str | None] = []
            for cell in row.findall(f"{SPACE}c"):
                place = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (place + 1 - len(cells))
                value, kind = cell.find(f"{SPACE}v"), cell.get("t", "n")
                if kind == "inlineStr":
                    cells[place] = _text(cell.find(f"{SPACE}is"))
                elif value is not None and value.text is not None and kind != "e":
                    cells[place] = shared[int(value.text)] if kind == "s" else value.text
            yield at, cells
            # The sheet would keep even an empty row.
            row.clear()
            if sheet_data is not None:
                sheet_data.clear()


def workbook_rows(files: DataFrame, sheet: int = 1) -> DataFrame:
    """path, row, cells of files with path and content; a file that is no workbook is an error."""
    schema = pa.schema([("path", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held: list[tuple] = []
                for row, cells in _rows(content.as_py(), sheet):
                    held.append((path, row, cells))
                    if len(held) == ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return files.select("path", "content").mapInArrow(read, "path string, row int, cells array<string>")


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def fail_reasons(rows: DataFrame, columns: tuple[int, int, int, int] = (0, 2, 5, 6), flag: int = 2) -> DataFrame:
    """group_id, mission, reasons (distinct, in order) of workbook rows whose flag is ``flag``; the columns are those of group, mission, reason and flag."""
    cell = lambda k: F.btrim(F.get("cells", F.lit(columns[k])), F.lit(" \t\r\n　"))
    found = rows.select(cell(0).alias("group_id"), cell(1).alias("mission"), cell(2).alias("reason"), cell(3).try_cast("double").alias("flag"))
    kept = found.where((F.col("flag") == flag) & (F.col("group_id") != "") & (F.col("mission") != "") & (F.col("reason") != "") & (F.lower("reason") != "nan"))
    return kept.groupBy("group_id", "mission").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


FIXED = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="1" sheetId="1" r:id="r1"/></sheets></workbook>',
}


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook_bytes(rows) -> bytes:
    """A workbook of rows of texts and numbers; null cells are left out."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in FIXED.items():
            book.writestr(name, text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for r, row in enumerate(rows, 1):
                cells = []
                for k, value in enumerate(row):
                    if isinstance(value, str):
                        cells.append(f'<c r="{_letters(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
                    elif value is not None:
                        cells.append(f'<c r="{_letters(k)}{r}"><v>{value}</v></c>')
                sheet.write(f'<row r="{r}">{"".join(cells)}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


#: Rows up to which a value's rows are one workbook.
ROWS_OF_A_BOOK = 50_000


def workbooks(rows: DataFrame, by: str, order: str, columns: list[str], most: int = ROWS_OF_A_BOOK) -> DataFrame:
    """``by``, content: workbooks per value, rows in order. A value with more than ``most`` rows has several, and its rows are dealt to them by hash.

    A book is one file and one task, so its size bounds a task's memory; the
    format itself ends at 2**20 rows.
    """
    kinds = dict(rows.dtypes)
    taken = rows.select(*dict.fromkeys([by, order, *columns]))
    counts = taken.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count(F.lit(1)) / most).alias("_books"))
    dealt = taken.join(counts, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_book", F.pmod(F.xxhash64(*taken.columns), F.col("_books"))).drop("_by", "_books")

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        content = workbook_bytes(zip(*(table.column(c).to_pylist() for c in columns)))
        return pa.table({by: table.column(by).slice(0, 1), "content": pa.array([content], pa.binary())})

    return dealt.groupBy(by, "_book").applyInArrow(write, f"{by} {kinds[by]}, content binary")
