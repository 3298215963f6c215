"""Spreadsheets as comma-separated text, over zipped XML, without a spreadsheet library.

``workbooks`` reads any path that Spark reads: files come as binary rows, each
sheet becomes a row with its part of the archive as it is packed, and is then
unpacked and parsed block by block in a task of its own; sheets of a file are
put together in the end. ``XlsxSource`` does the same file by file for files
that the machines see under one path.
"""

from __future__ import annotations

import csv
import io
import re
import time
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path
from xml.etree.ElementTree import XMLPullParser, iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LIMIT, EXPANDED, RATIO, CELLS, SECONDS = 10 << 20, 200 << 20, 200, 2_000_000, 60


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


STRINGS = "xl/sharedStrings.xml"


def _blocks(f) -> Iterator[bytes]:
    while block := f.read(1 << 16):
        yield block


def _elements(blocks: Iterable[bytes]) -> Iterator:
    """Elements as they end, of XML that comes block by block."""
    parser = XMLPullParser(("end",))
    for block in blocks:
        parser.feed(block)
        for _, node in parser.read_events():
            yield node
    parser.close()


def _strings(blocks: Iterable[bytes]) -> list[str]:
    out: list[str] = []
    for node in _elements(blocks):
        if _local(node.tag) == "si":
            out.append("".join(t.text or "" for t in node.iter() if _local(t.tag) == "t"))
            node.clear()
    return out


def _shared(book: zipfile.ZipFile) -> list[str]:
    if STRINGS not in book.namelist():
        return []
    with book.open(STRINGS) as f:
        return _strings(_blocks(f))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and parts in the order of the workbook."""
    targets = {}
    with book.open("xl/_rels/workbook.xml.rels") as f:
        for _, node in iterparse(f):
            if "Id" in node.attrib:
                target = node.attrib["Target"]
                targets[node.attrib["Id"]] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    out = []
    with book.open("xl/workbook.xml") as f:
        for _, node in iterparse(f):
            if _local(node.tag) == "sheet":
                key = next((v for k, v in node.attrib.items() if _local(k) == "id"), "")
                out.append((node.attrib.get("name", ""), targets.get(key, "")))
    return [s for s in out if s[1] in book.namelist()]


def _value(cell, shared: list[str]):
    kind = cell.attrib.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    raw = next((v.text for v in cell if _local(v.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw == "1"
    if kind == "n":
        number = float(raw)
        return int(number) if number.is_integer() and "e" not in raw.lower() and "." not in raw else number
    return raw


def _rows(blocks: Iterable[bytes], shared: list[str]) -> Iterator[list]:
    for node in _elements(blocks):
        if _local(node.tag) != "row":
            continue
        row: list = []
        for cell in node:
            at = _column(cell.attrib.get("r", "")) if cell.attrib.get("r") else len(row)
            row += [None] * (at - len(row)) + [_value(cell, shared)]
            if len(row) > CELLS:
                break
        yield row
        node.clear()


def _sheet_csv(rows: Iterable[list], used: int, until: float) -> tuple[str, int]:
    """The rows as text, empty ones left out, and how many cells are used by then."""
    out = io.StringIO()
    writer = csv.writer(out)
    for row in rows:
        used += len(row)
        if used > CELLS or time.monotonic() > until:
            raise ValueError(TOO_MANY)
        if any(v is not None for v in row):
            writer.writerow(["" if v is None else v for v in row])
    return out.getvalue(), used


TOO_MANY, UNREADABLE = "The spreadsheet has too many cells or takes too long.", "The spreadsheet can't be read."


def _heading(k: int, name: str, sheets: int) -> str:
    return ("\n" if k else "") + f"# --- Sheet: {name} ---\n" if sheets > 1 else ""


def _book(data: bytes) -> zipfile.ZipFile:
    if len(data) > LIMIT:
        raise ValueError("The spreadsheet is too large.")
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise ValueError("Not a spreadsheet.") from None
    size = sum(i.file_size for i in book.infolist())
    if size > EXPANDED or size > RATIO * max(1, len(data)):
        raise ValueError("The spreadsheet expands too much.")
    return book


def to_csv(data: bytes) -> str:
    """All sheets, one after the other; each under its name where there are several. Empty rows go. ValueError beyond the limits."""
    book, out, used, until = _book(data), [], 0, time.monotonic() + SECONDS
    try:
        shared, sheets = _shared(book), _sheets(book)
        for k, (name, part) in enumerate(sheets):
            with book.open(part) as f:
                text, used = _sheet_csv(_rows(_blocks(f), shared), used, until)
            out += [_heading(k, name, len(sheets)), text]
    except (KeyError, IndexError, SyntaxError) as e:
        raise ValueError(UNREADABLE) from e
    return "".join(out)


def _packed(data: bytes, book: zipfile.ZipFile, part: str) -> tuple[bytes, int]:
    """A part of the archive as it lies there, and how it is packed."""
    info = book.getinfo(part)
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return book.read(part), zipfile.ZIP_STORED
    head = data[info.header_offset : info.header_offset + 30]
    begin = info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    return data[begin : begin + info.compress_size], info.compress_type


def _unpacked(data: bytes, kind: int) -> Iterator[bytes]:
    """Blocks of a packed part; ValueError where it grows beyond ``EXPANDED``, whatever the archive says of it."""
    unpack, size = zlib.decompressobj(-15) if kind == zipfile.ZIP_DEFLATED else None, 0
    for k in range(0, len(data), 1 << 16):
        block = data[k : k + (1 << 16)]
        while block:
            out = unpack.decompress(block, 1 << 20) if unpack else block
            block = unpack.unconsumed_tail if unpack else b""
            size += len(out)
            if size > EXPANDED:
                raise ValueError("The spreadsheet expands too much.")
            yield out


PART = "path string, k int, sheets int, name string, sheet binary, sheet_kind int, strings binary, strings_kind int, error string"
SHEET = "path string, k int, sheets int, name string, csv string, cells long, error string"


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.large_binary()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t] if t != "binary" else pa.binary()) for i, t in enumerate(types)], list(names))


def sheets(files: DataFrame) -> DataFrame:
    """``SHEET`` of ``files (path, content)``: one row for each sheet, parsed in a task of its own, or for a file that can't be read (``error``; null content is too large)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("The spreadsheet is too large.")
                    book = _book(data)
                    found = _sheets(book)
                    strings = _packed(data, book, STRINGS) if STRINGS in book.namelist() else (None, 0)
                    rows = [(path, k, len(found), name, *_packed(data, book, part), *strings, None) for k, (name, part) in enumerate(found)]
                except ValueError as e:
                    rows = [(path, 0, 0, None, None, 0, None, 0, str(e))]
                except (KeyError, IndexError, SyntaxError):
                    rows = [(path, 0, 0, None, None, 0, None, 0, UNREADABLE)]
                for row in rows or [(path, 0, 0, None, None, 0, None, 0, None)]:
                    yield _batch([row], PART)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, k, n, name, sheet, kind, strings, strings_kind, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, used = None, 0
                if sheet is not None:
                    try:
                        shared = _strings(_unpacked(strings, strings_kind)) if strings is not None else []
                        text, used = _sheet_csv(_rows(_unpacked(sheet, kind), shared), 0, time.monotonic() + SECONDS)
                    except ValueError as e:
                        error = str(e)
                    except (KeyError, IndexError, SyntaxError, zlib.error):
                        error = UNREADABLE
                yield _batch([(path, k, n, name, text, used, error)], SHEET)

    dealt = files.select("path", "content").mapInArrow(parts, PART).repartition("path", "k")
    return dealt.mapInArrow(parsed, SHEET)


def put_together(found: DataFrame) -> DataFrame:
    """``path, csv, error`` of each file's ``sheets``, in their order, like ``to_csv``."""
    one = F.struct("k", "sheets", "name", "csv", "cells", "error")
    each = found.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("all"))
    heading = lambda s: F.when(s["sheets"] > 1, F.concat(F.when(s["k"] > 0, "\n").otherwise(""), F.lit("# --- Sheet: "), s["name"], F.lit(" ---\n"))).otherwise("")
    text = F.array_join(F.transform("all", lambda s: F.concat(heading(s), F.coalesce(s["csv"], F.lit("")))), "")
    cells = F.aggregate("all", F.lit(0).cast("long"), lambda n, s: n + s["cells"])
    error = F.coalesce(F.get(F.filter(F.col("all.error"), lambda e: e.isNotNull()), F.lit(0)), F.when(cells > CELLS, TOO_MANY))
    return each.select("path", F.when(error.isNull(), text).alias("csv"), error.alias("error"))


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``path, csv, error`` of the spreadsheets (``.xlsx``, ``.xlsm``) at any path that Spark reads, in folders below it too; content is read up to ``LIMIT`` bytes a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,xlsm,XLSX,XLSM}").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= LIMIT).select("path", "content")
    large = files.where(F.col("length") > LIMIT).select("path", F.lit(None).cast("binary").alias("content"))
    return put_together(sheets(small.unionByName(large)))


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").load(folder or file)``: ``path, csv, error``, one row for each file."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "path string, csv string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = Path(path)

    def partitions(self) -> list[InputPartition]:
        files = sorted(p for p in self.path.iterdir() if p.suffix.lower() in (".xlsx", ".xlsm")) if self.path.is_dir() else [self.path]
        return [InputPartition(str(f)) for f in files]

    def read(self, partition: InputPartition):
        try:
            yield partition.value, to_csv(Path(partition.value).read_bytes()), None
        except ValueError as e:
            yield partition.value, None, str(e)
