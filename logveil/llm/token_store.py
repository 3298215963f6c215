"""Token ids in Parquet list columns.

One row holds a document: ``doc_id, n_tokens, n_chars, ids array<int>``. The
writer orders rows by ``doc_id`` over all files, keeps ids delta-packed or
dictionary-coded as asked, bounds row groups and pages, and Parquet's column
and page indexes let a reader take single documents or the counts alone
without the ids.

The tokenizers library encodes every distinct white-space-separated word once
for each cache; its normaliser, splitter and merges never look across white
space, so a text's ids are those of its words in a row (a test holds this
against the library over whole texts).
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _SPACE, lean, shared_dir, utf8


BEYOND = re.compile(rb"[\xc6-\xff]")


def _lower(text: bytes) -> bytes:
    """Letters of ASCII in lower case, unless the text has characters that might compose with them."""
    return text.lower() if text.isascii() or not BEYOND.search(text) else text


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()
# small letters up to U+017F, and words of them and of printable ASCII without an apostrophe
SYMBOLS = b"!#$%&*,.:;?|"
SMALL = "a-z\u00df-\u00f6\u00f8-\u017f"
PLAIN = re.compile(f"[{SMALL}!-&(-@\\[-~]*")
PARTS = re.compile(f"[{SMALL}]+|[0-9]|[^{SMALL}0-9]+")


AT_ONCE = 12 << 20  # bytes of text
#: What a tokenizer's file must say for its words to be split here; any other file's texts go through the library whole.
SPLIT_HERE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def splits_here(path: str) -> bool:
    """Whether the file's settings are those that the word splitter follows, and its model is a plain BPE."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "fuse_unk", "byte_fallback", "ignore_merges", "continuing_subword_prefix"))
    return plain and all(told.get(k) == v for k, v in SPLIT_HERE.items()) and all(t["special"] for t in told["added_tokens"])


class Known(dict):
    """Ids (32-bit integers) by word, made at the first use; those of long runs without white space are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        ids = self.make(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of words by the tokenizers library.

    A word of letters up to U+017F and printable ASCII without an apostrophe
    has parts that are plain to see, and the library's merges take each part
    once; every other word goes through the whole library, and so does every
    whole text where the tokenizer's file has other settings than
    ``SPLIT_HERE``.
    """

    def __init__(self, path: str, cache: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.library.no_truncation()
        self.library.no_padding()
        self.split = splits_here(path)
        self.merge = self.library.model.tokenize
        self.words = Known(self._word)
        self.parts: dict[str, bytes] = {}
        self.limit = cache

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(LETTERS)
            got = array("i", [t.id for t in self.merge(letters)]).tobytes()
            if len(part) <= 64:
                self.parts[part] = got
        return got

    def _word(self, raw: bytes) -> bytes:
        stem = raw.rstrip(SYMBOLS)
        if stem.isalpha():  # of bytes: ASCII letters
            ids = self._part(stem.lower().decode())
            return ids + self._part(raw[len(stem) :].decode()) if len(stem) < len(raw) else ids
        word = raw.decode("utf-8", "replace")
        if not BEYOND.search(raw) and PLAIN.fullmatch(low := word.lower()):
            return b"".join(map(self._part, PARTS.findall(low)))
        return array("i", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the UTF-8 texts in a row, and where each text's begin (one more entry ends the last).

        Words are split at ASCII white space only; the library treats any
        other inside a word. A text of no character beyond U+017F, where no
        composition can happen, has its ASCII letters lower-cased first, as the
        library would. The words of all texts are dictionary-coded by Arrow,
        each with the white space after it, and ids are gathered by code.
        """
        if not self.split:
            each = [e.ids for e in self.library.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], np.int32), np.cumsum([0, *map(len, each)])
        if len(self.words) + len(self.parts) > self.limit:
            self.words.clear()
            self.parts.clear()
        raw = np.frombuffer(b" ".join([*map(_lower, texts), b""]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        inside = ~_SPACE[raw]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if inside[:1].any():
            starts = np.append(0, starts)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        offsets = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        ids_of = self.words.__getitem__
        each = [ids_of(w.rstrip()) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        known = np.frombuffer(b"".join(each), np.int32)
        code = coded.indices.to_numpy()
        length = size[code]
        before = np.zeros(len(code) + 1, np.int64)
        np.cumsum(length, out=before[1:])
        place = np.repeat((np.cumsum(size) - size)[code] - before[:-1], length)
        place += np.arange(before[-1])
        return known[place], before[np.append(0, np.searchsorted(starts, ends))]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_documents(docs: DataFrame, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_chars, ids`` of each row; ``end_id`` closes every document.

    Null and empty texts have only the end id. Repeated ids and rows are kept
    as they are, extra columns ignored, an empty table gives an empty one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = encoder(path)
        keys: list[pa.Array] = []
        texts: list[bytes] = []

        def coded() -> pa.RecordBatch:
            ids, at = words.encode(texts)
            if end_id is not None:
                ids = np.insert(ids, at[1:], np.int32(end_id))
                at = at + np.arange(len(at))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            chars = pa.array([len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in texts], pa.int64())
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(np.diff(at)), chars, lists], ["doc_id", "n_tokens", "n_chars", "ids"])
            keys.clear(), texts.clear()
            return out

        size = 0
        for batch in batches:
            more = utf8(batch.column(1))
            keys.append(batch.column(0))
            texts += more
            size += sum(map(len, more))
            if size >= AT_ONCE:
                yield coded()
                size = 0
        if texts:
            yield coded()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(encode), "doc_id long, n_tokens long, n_chars long, ids array<int>")


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None, encoding: str = "delta", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes ``docs`` and writes them in ascending ``doc_id`` order over all files, file names included.

    The texts are dealt out by ranges of the id before they are encoded: the
    sample that finds the ranges reads ids alone, and each text is encoded
    once. ``encoding``: ``delta`` (DELTA_BINARY_PACKED, dictionary off) or
    ``dictionary``. Row groups and pages end at the given sizes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = encode_documents(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), tokenizer, end_id)
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }
    ordered.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ids: bool = True) -> DataFrame:
    """The documents from ``low`` to ``high``, or only their counts: filters reach row-group and page indexes, columns the scan."""
    out = spark.read.schema("doc_id long, n_tokens long, n_chars long, ids array<int>").parquet(path)
    if low is not None:
        out = out.where(F.col("doc_id") >= low)
    if high is not None:
        out = out.where(F.col("doc_id") <= high)
    return out if ids else out.drop("ids")


def with_starts(rows: DataFrame, counts: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds ``start`` to ``rows (doc_id, n_tokens, …)``: the ids of all documents before each, in ``doc_id`` order.

    ``counts`` has the same ``doc_id`` and ``n_tokens``, cheap to read. Its
    sums by range of ``doc_id`` are gathered first (as many rows as ranges,
    which the parameter bounds), so no window spans the table. Rows that
    repeat a ``doc_id`` are ordered by their size.
    """
    parts = parts or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = counts.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    edges = sorted({int(e) for e in edges})
    keys = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array().cast("array<bigint>")
    part = F.size(F.filter(keys, lambda e: e < F.col("doc_id")))
    before, total = {}, 0
    for row in counts.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # at most ``parts`` rows
        before[row["part"]], total = total, total + row["n"]
    own = Window.partitionBy("part").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    table = F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(len(edges) + 1)])
    return rows.withColumn("part", part).withColumn("start", F.get(table, F.col("part")) + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).drop("part")


def ids_crc32(stored: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32``: CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            lists = batch.column(2)
            flat, at = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B"), (np.asarray(lists.offsets) * 4).tolist()
            crc = [crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"])

    return stored.select("doc_id", "n_tokens", "ids").mapInArrow(lean(digest), "doc_id long, n_tokens long, ids_crc32 long")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_dir(spark)
    write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return with_starts(ids_crc32(read_tokens(spark, path)), read_tokens(spark, path, ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")
