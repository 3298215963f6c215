"""Text files of unknown encoding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 10 << 20


def encoding_of(raw: bytes) -> str:
    """``utf-8``, ``utf-16-le``, ``utf-16-be``, or ``utf-32-…`` (refused): by a mark, else by where the zero bytes are."""
    for mark, name in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return name
    head = raw[:4096]
    pairs = len(head) / 2
    if pairs >= 8:
        even, odd = head[::2].count(0), head[1::2].count(0)
        if odd > 0.3 * pairs and even <= 0.05 * pairs:
            return "utf-16-le"
        if even > 0.3 * pairs and odd <= 0.05 * pairs:
            return "utf-16-be"
    return "utf-8"


def decode(raw: bytes) -> tuple[str | None, str, str | None]:
    """Text with ``\\n`` at line ends and without a mark, its encoding, and an error (UTF-32, binary, too long) in place of the text."""
    if len(raw) > LIMIT:
        return None, "", "too large"
    encoding = encoding_of(raw)
    if encoding.startswith("utf-32"):
        return None, encoding, "UTF-32 is not read"
    text = raw.decode(encoding, "replace").removeprefix("﻿")
    if "\0" in text:
        return None, encoding, "binary"
    return text.replace("\r\n", "\n").replace("\r", "\n"), encoding, None


def normalise(text: Column) -> Column:
    """Line ends and the mark of a text column."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def decoded(files: DataFrame) -> DataFrame:
    """``path, text, encoding, error`` of ``files (path, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                out = [decode(c or b"") for c in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([o[k] for o in out], pa.string()) for k in range(3))], ["path", "text", "encoding", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, encoding string, error string")


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under ``path`` as documents; those larger than the limit are left unread, with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    small = decoded(files.where(F.col("length") <= LIMIT))
    large = files.where(F.col("length") > LIMIT).select("path", F.lit(None).cast("string").alias("text"), F.lit("").alias("encoding"), F.lit("too large").alias("error"))
    return small.unionByName(large)


def review(masked: Column) -> Column:
    """Masked text as HTML with its placeholders marked."""
    safe = F.replace(F.replace(F.replace(masked, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, r"(\[[A-Z0-9]+_\d+\])", "<mark>$1</mark>")


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def restored(masked: Column, mapping: Column) -> Column:
    """Restored text as HTML, each value marked with the placeholder that it stands for.

    Values go in where placeholders stood, in one pass, so a value inside
    another one is never marked again. Unknown placeholders stay.
    """
    shape = r"\[[A-Z0-9]+_\d+\]"
    gaps, found = F.split(masked, shape, -1), F.regexp_extract_all(masked, F.lit(shape), F.lit(0))

    def shown(p: Column) -> Column:
        value = F.try_element_at(mapping, p)
        return F.when(value.isNull(), _escaped(p)).otherwise(F.concat(F.lit('<mark title="'), p, F.lit('">'), _escaped(value), F.lit("</mark>")))

    return F.concat(_escaped(F.element_at(gaps, 1)), F.array_join(F.transform(found, lambda p, i: F.concat(shown(p), _escaped(F.get(gaps, i + 1)))), ""))


def write_masked(masked: DataFrame, path: str, id_col: str = "doc_id", html: bool = False) -> None:
    """Masked texts as files, a folder ``<id_col>=...`` for each document, as text or with placeholders marked as HTML."""
    shown = review(F.col("masked")) if html else F.col("masked")
    masked.select(id_col, F.coalesce(shown, F.lit("")).alias("value")).write.partitionBy(id_col).option("lineSep", "\n").text(path)
