"""Excel workbooks (Office Open XML) as tables: read and written with the standard library, row by row, on executors.

A workbook is a zip of XML files. Spark reads it as bytes, from any store that it can read, and a task turns it into rows as the
XML streams by; it holds the compressed file, its shared strings and one batch. A sheet has at most 1,048,576 rows by the format, so
that a file is a bounded task; larger tables are written as several files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sheet, by the format; rows of a batch.
MOST_ROWS, BATCH = 1_048_576, 5_000
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
CELLS = "path string, sheet string, row long, cells array<string>"


def _strings(z: zipfile.ZipFile) -> list[str]:
    """The shared strings; runs of rich text are joined."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in iterparse(f):
            if e.tag == f"{_NS}si":
                out.append("".join(t.text or "" for t in e.iter(f"{_NS}t")))
                e.clear()
    return out


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of every sheet, in the order of the workbook."""
    with z.open("xl/_rels/workbook.xml.rels") as f:
        targets = {e.get("Id"): e.get("Target") for _, e in iterparse(f) if e.tag.endswith("}Relationship")}
    with z.open("xl/workbook.xml") as f:
        found = [(e.get("name"), next(v for k, v in e.attrib.items() if k.endswith("}id"))) for _, e in iterparse(f) if e.tag == f"{_NS}sheet"]
    part = lambda t: t[1:] if t.startswith("/") else f"xl/{t}"
    return [(n, part(targets[i])) for n, i in found if i in targets]


def column_number(reference: str) -> int:
    """Place, from 0, of a cell's column: A is 0, Z is 25, AA is 26."""
    out = 0
    for c in reference:
        if not c.isalpha():
            break
        out = out * 26 + ord(c.upper()) - 64
    return out - 1


def rows_of(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells as text) of a workbook; cells that a row lacks before its last one are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = _strings(z)
        for name, part in _sheets(z):
            with z.open(part) as f:
                number = 0
                for _, e in iterparse(f):
                    if e.tag != f"{_NS}row":
                        continue
                    number = int(e.get("r") or number + 1)
                    cells: list[str | None] = []
                    for c in e.iter(f"{_NS}c"):
                        at = column_number(c.get("r")) if c.get("r") else len(cells)
                        kind, v = c.get("t"), c.find(f"{_NS}v")
                        text = None if v is None else v.text
                        if kind == "s" and text is not None:
                            text = strings[int(text)]
                        elif kind == "inlineStr":
                            text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                        cells += [None] * (at - len(cells) + 1)
                        cells[at] = text
                    yield name, number, cells
                    e.clear()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `sheet`, `row` and `cells` (as text) of every row of the workbooks at a path or below a folder.

    A file that is no workbook ends the job with an error that names it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
        shown = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "sheet", "row", "cells"])
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    for sheet, number, cells in rows_of(content):
                        rows.append((where, sheet, number, cells))
                        if len(rows) == BATCH:
                            yield shown(rows)
                            rows = []
                except (zipfile.BadZipFile, KeyError, SyntaxError) as e:
                    raise ValueError(f"{where} is not a workbook: {e}") from e
                if rows:
                    yield shown(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInArrow(run, CELLS)


def when(text: Column) -> Column:
    """A cell as a time: a number counts days since 1899-12-30, as Excel writes times; other text is read as a time."""
    days = text.try_cast("double")
    return F.when(days.isNotNull(), F.timestamp_micros((F.round(days * 86_400_000_000 / 1000) * 1000).cast("long") - F.lit(25_569 * 86_400_000_000))).otherwise(text.try_cast("timestamp"))


def table(cells: DataFrame, header: bool = True, names: list[str] | None = None) -> DataFrame:
    """Cells as columns of text: named by `names`, or by the first row of the first file, which each file is taken to begin with."""
    if names is None:
        first = cells.filter("row = 1").orderBy("path", "sheet").select("cells").first()
        names = [] if first is None else [(c or f"column_{i}").strip() for i, c in enumerate(first[0])]
    rows = cells.filter("row > 1") if header else cells
    return rows.select("path", "row", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


# -- writing ---------------------------------------------------------------------------------------------

#: The parts of a workbook with one sheet.
_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(rows: Iterator[list], stream) -> None:
    """Write rows as a workbook with one sheet: numbers as numbers, None as no cell, all else as text without control characters."""
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml"))
        z.writestr("xl/workbook.xml", _BOOK)
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format(kind="worksheet", target="worksheets/sheet1.xml"))
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_NS[1:-1]}"><sheetData>'.encode())
            for n, row in enumerate(rows, 1):
                cells = []
                for i, v in enumerate(row):
                    if v is None:
                        continue
                    at = f'r="{column_name(i)}{n}"'
                    if isinstance(v, int | float) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
                        cells.append(f"<c {at}><v>{v!r}</v></c>")
                    else:
                        cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(_UNWRITABLE.sub("", str(v)))}</t></is></c>')
                f.write(f'<row r="{n}">{"".join(cells)}</row>'.encode())
            f.write(b"</sheetData></worksheet>")


def write(df: DataFrame, path: str, header: bool = True, most: int = MOST_ROWS) -> DataFrame:
    """Write each of the frame's partitions as workbooks below a folder that all executors reach; `path` and `rows` of each.

    A file is named after its partition and its place in it, so that an attempt that is made again writes the same files. Times should
    be numbers or text by then. Rows keep their order within a partition.
    """
    from itertools import chain, islice

    from pyspark import TaskContext

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(path)
        store.create_dir(where, recursive=True)
        rows = (list(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        part, k = TaskContext.get().partitionId(), 0
        while (first := next(rows, None)) is not None:
            name, count = f"{where}/part-{part:05d}-{k:03d}.xlsx", 0

            def counted(rows=chain([first], islice(rows, most - 1 - header))):
                nonlocal count
                for r in rows:
                    count += 1
                    yield r

            with store.open_output_stream(name, compression=None) as f:
                workbook(chain([names] if header else [], counted()), f)
            yield pa.record_batch([pa.array([name]), pa.array([count])], names=["path", "rows"])
            k += 1

    return df.mapInArrow(run, "path string, rows long")
