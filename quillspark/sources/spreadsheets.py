"""Spreadsheets (xlsx) as tables: a reader and a writer that stream the sheet's XML with the standard library.

A workbook is a zip of XML parts. The reader gets whole files from Spark's ``binaryFile`` source, so they may lie in any
store that Spark reads; a task holds the workbooks of a split (a sheet has at most 1,048,576 rows) and hands their rows on in
small batches. Columns are found by the names in the first row. The writer makes workbooks of bounded size in a folder, one
or more per partition, renamed into place once whole, so a task that runs again leaves no torn file.

Cells: an absent or error cell is null, an empty text cell is the empty text. Line breaks, outer spaces and control characters
come back as they were written (``_xHHHH_`` escapes). Numbers keep their digits; a text column gets a number as it stands in
the file. Dates are numbers in the file and are read as such. Texts are written whole; spreadsheet programs show at most
32,767 characters of a cell.
"""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Iterator
from itertools import chain
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import _typed
from .sinks import task_filesystem

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of one sheet, with its header (the format's limit).
SHEET_ROWS = 1_048_576
#: Characters of the cells handed on at once.
BATCH_CHARS = 4 << 20
#: Characters of a workbook's cells beyond which its writer begins another: a reader holds a whole workbook.
BOOK_CHARS = 16 << 20
#: Rows that the writer turns into Python values at once.
WRITE_ROWS = 256

# ------------------------------------------------------------------ reading

_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _text_of(element) -> str:
    """Text of a string item: its own ``t``, or those of its runs; phonetic hints are left out."""
    runs = [t for e in element if e.tag in (MAIN + "t", MAIN + "r") for t in ([e] if e.tag == MAIN + "t" else e.iter(MAIN + "t"))]
    return unescape_text("".join(t.text or "" for t in runs))


def _column(reference: str) -> int:
    """Column number from 0 of a cell reference such as ``AB12``."""
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _sheet_part(book: zipfile.ZipFile, sheet: str | int) -> str:
    sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"))
    names = [s.get("name") for s in sheets]
    if isinstance(sheet, str) and sheet not in names:
        raise ValueError(f"no sheet {sheet!r}; there are {', '.join(names)}")
    at = names.index(sheet) if isinstance(sheet, str) else sheet
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[sheets[at].get(REL + "id")]
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


def read_rows(content: bytes | pa.Buffer, sheet: str | int = 0) -> Iterator[dict]:
    """The rows of a sheet as ``{column number: text or None}``, one after another; empty rows between are left out."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else pa.BufferReader(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for _, e in ElementTree.iterparse(part):
                    if e.tag == MAIN + "si":
                        shared.append(_text_of(e))
                        e.clear()
        with book.open(_sheet_part(book, sheet)) as part:
            data = None
            for event, e in ElementTree.iterparse(part, events=("start", "end")):
                if event == "start":
                    data = e if e.tag == MAIN + "sheetData" else data
                    continue
                if e.tag != MAIN + "row":
                    continue
                row = {}
                for c in e:
                    at = _column(c.get("r")) if c.get("r") else max(row, default=-1) + 1
                    kind, value = c.get("t", "n"), c.find(MAIN + "v")
                    if kind == "inlineStr":
                        item = c.find(MAIN + "is")
                        row[at] = _text_of(item) if item is not None else None
                    elif kind == "e" or value is None or value.text is None:
                        row[at] = "" if kind == "str" and value is not None else None
                    elif kind == "s":
                        row[at] = shared[int(value.text)]
                    elif kind == "b":
                        row[at] = "true" if value.text == "1" else "false"
                    else:
                        row[at] = unescape_text(value.text) if kind == "str" else value.text
                if row:
                    yield row
                if data is not None:
                    data.clear()  # rows passed are not kept


def read_xlsx(spark: SparkSession, path: str, schema: T.StructType, sheet: str | int = 0, order: str | None = None) -> DataFrame:
    """Columns of ``schema`` by the names in the first row of a workbook, or of each workbook of a folder.

    A missing column, and a value that doesn't fit its type, are errors. ``order`` names a column for the row's place: file and
    row number.
    """
    names = [f.name for f in schema.fields]
    fields = [pa.field("file", pa.string()), pa.field("row", pa.int64()), *[pa.field(n, pa.string()) for n in names]]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema(fields)

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, chars, places = [], 0, None
                for i, row in enumerate(read_rows(content.as_buffer(), sheet)):
                    if places is None:
                        header = {v: k for k, v in row.items()}
                        if missing := [n for n in names if n not in header]:
                            raise ValueError(f"{file} has no column {', '.join(missing)}; it has {', '.join(map(str, header))}")
                        places = [header[n] for n in names]
                        continue
                    cells = [row.get(p) for p in places]
                    rows.append((file, i, *cells))
                    chars += sum(len(c) for c in cells if c) + 64
                    if chars > BATCH_CHARS:
                        yield batch_of(rows)
                        rows, chars = [], 0
                if rows:
                    yield batch_of(rows)

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    text = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), *[T.StructField(f"{n}", T.StringType()) for n in names]])
    rows = raw.mapInArrow(parse, text)
    place = [F.struct(F.col("file"), F.col("row")).alias(order)] if order else []
    return rows.select(*[_typed(f.name, f.dataType) for f in schema.fields], *place)


# ------------------------------------------------------------------ writing

_NOT_XML = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_TYPES = _HEAD + (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
)
_LINK = '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>'
_LINKS = _HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + _LINK + "</Relationships>"
_BOOK = _HEAD + (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
_SHEET = _HEAD + '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'


def escape_text(text: str) -> str:
    return escape(_NOT_XML.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _letters(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def _cell(reference: str, value) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, str):
        return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape_text(value)}</t></is></c>'
    return f'<c r="{reference}"><v>{value!r}</v></c>' if isinstance(value, (int, float)) else f'<c r="{reference}"><v>{value}</v></c>'


def write_book(stream, names: list, rows: Iterator, sheet: str = "Sheet1", most: int = SHEET_ROWS) -> int:
    """A workbook of the header and the next rows, ``most`` lines or about BOOK_CHARS characters at most; returns how many
    rows it took."""
    letters, taken, chars = [_letters(i) for i in range(len(names))], 0, 0
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _TYPES)
        book.writestr("_rels/.rels", _LINKS.format(kind="officeDocument", target="xl/workbook.xml"))
        book.writestr("xl/workbook.xml", _BOOK.format(name=escape(sheet, {'"': "&quot;"})))
        book.writestr("xl/_rels/workbook.xml.rels", _LINKS.format(kind="worksheet", target="worksheets/sheet1.xml"))
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as part:
            part.write(_SHEET.encode())

            def line(number: int, values) -> None:
                cells = "".join(_cell(f"{a}{number}", v) for a, v in zip(letters, values))
                part.write(f'<row r="{number}">{cells}</row>'.encode())

            line(1, names)
            while taken < most - 1 and chars < BOOK_CHARS and (row := next(rows, None)) is not None:
                taken += 1
                chars += sum(len(v) for v in row if isinstance(v, str)) + 32 * len(row)
                line(taken + 1, row)
            part.write(b"</sheetData></worksheet>")
    return taken


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1", most: int = SHEET_ROWS) -> str:
    """Workbooks ``part-*.xlsx`` in the folder ``path``, one per partition (more where a sheet or a workbook is full). Columns other than
    texts, numbers and truth values are written as text. ``path`` must be a folder that tasks can reach (see
    ``sinks.task_filesystem``). An empty table gives one workbook with the header."""
    plain = (T.StringType, T.NumericType, T.BooleanType)
    names = df.columns
    typed = df.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema.fields])

    def write_files(partition: int, rows: Iterator) -> int:
        target, root = task_filesystem(path)
        target.create_dir(root, recursive=True)
        files = 0
        first = next(rows, None)
        while first is not None or (partition < 0 and not files):
            part = f"part-{max(partition, 0):05d}-{files:03d}.xlsx"
            with target.open_output_stream(f"{root}/_{part}.tmp") as stream:
                write_book(stream, names, iter(()) if first is None else chain([first], rows), sheet, most)
            target.move(f"{root}/_{part}.tmp", f"{root}/{part}")
            files += 1
            first = next(rows, None)
        return files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        few = (b.slice(i, WRITE_ROWS) for b in batches for i in range(0, b.num_rows, WRITE_ROWS))
        rows = (row for b in few for row in zip(*(c.to_pylist() for c in b.columns)))
        yield pa.RecordBatch.from_arrays([pa.array([write_files(TaskContext.get().partitionId(), rows)], pa.int64())], names=["files"])

    if not typed.mapInArrow(run, "files long").agg(F.sum("files")).first()[0]:
        write_files(-1, iter(()))
    return path
