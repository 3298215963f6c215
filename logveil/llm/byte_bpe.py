"""Byte-level BPE encoding and decoding of whole texts.

Pre-tokenisation is vectorised over all texts of a batch. Every code point has
a class from a table over all of Unicode; a space carries whether it ends a
white-space run, an apostrophe how many letters of a contraction follow. Class
and look-ahead make a symbol, and each symbol is a transition function of a
small automaton. Composition of such functions is associative, so the text is
cut into equal blocks, the function of each block is composed for all blocks
at once, a scan over blocks gives the state before each, and a second pass
gives all states; boundaries follow by table. No regular expression is used.
The slices feed pair merging behind a cache, and offsets of the tokens in the
UTF-8 text are kept on request.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, lean, utf8

# Symbols: letter, number, other, apostrophe with a contraction of one or two
# letters after it, space before a visible character, other white space before
# one, white space inside or at the end of a run, end of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, GLUE, EDGE, INNER, STOP = range(9)
# States: between texts, in letters, in numbers, in others, in white space,
# after a space that belongs to the next run, one or two contraction letters
# to come, contraction complete.
NONE, IN_L, IN_N, IN_O, IN_W, GLUED, WANT1, WANT2, DONE = range(9)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """``move[symbol, state]`` and ``cut[symbol, state]``: whether a token begins at the symbol."""
    move = np.zeros((9, 9), np.uint8)
    cut = np.zeros((9, 9), bool)
    runs = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O}
    for state in range(9):
        for symbol, own in runs.items():
            move[symbol, state], cut[symbol, state] = own, state not in (own, GLUED)
        for symbol, want in ((SHORT, WANT1), (LONG, WANT2)):
            joined = state in (IN_O, GLUED)
            move[symbol, state], cut[symbol, state] = (IN_O if joined else want), not joined
        move[GLUE, state], cut[GLUE, state] = GLUED, True
        move[EDGE, state], cut[EDGE, state] = IN_W, True
        move[INNER, state], cut[INNER, state] = IN_W, state != IN_W
        move[STOP, state], cut[STOP, state] = NONE, True
    move[LETTER, WANT2], cut[LETTER, WANT2] = WANT1, False
    move[LETTER, WANT1], cut[LETTER, WANT1] = DONE, False
    return move, cut


MOVE, CUT = _automaton()
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INNER (white space) of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = INNER
    return out


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``points``: the texts, each with a 0 at its place in ``ends``."""
    kind = classes()[points]
    kind[ends] = STOP
    after = np.append(kind[1:], STOP)
    white = np.flatnonzero((kind == INNER) & (after < GLUE))
    kind[white] = np.where(points[white] == 0x20, GLUE, EDGE)
    quote = np.flatnonzero((points == 0x27) & (after == LETTER))
    if len(quote):
        padded = np.append(points, [0, 0])
        a, b = padded[quote + 1], padded[quote + 2]
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        kind[quote[short]] = SHORT
        kind[quote[long]] = LONG
    return kind


def token_starts(points: np.ndarray, ends: np.ndarray, block: int = 256) -> np.ndarray:
    """Where tokens (and the ends of texts) begin."""
    symbols = _symbols(points, ends)
    n = len(symbols)
    rows = -(-n // block)
    grid = np.full(rows * block, STOP, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    flat = MOVE.reshape(-1)
    whole = np.broadcast_to(np.arange(9, dtype=np.uint8), (rows, 9)).copy()
    for column in grid:
        whole = flat[column[:, None].astype(np.intp) * 9 + whole]
    entry = np.empty(rows, np.uint8)
    state = NONE
    for i, function in enumerate(whole.tolist()):
        entry[i] = state
        state = function[state]
    before = np.empty((block, rows), np.uint8)
    state = entry
    for i, column in enumerate(grid):
        before[i] = state
        state = flat[column.astype(np.intp) * 9 + state]
    starts = CUT.reshape(-1)[grid.astype(np.intp) * 9 + before]
    return np.flatnonzero(starts.T.reshape(-1)[:n])


def pre_tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts in a row, and the place of the mark that ends each text. Bytes that aren't UTF-8 are read as U+FFFD."""
    joined = b"\0".join([*texts, b""])
    try:
        plain = joined.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        texts = [t.decode("utf-8", "replace").encode() for t in texts]
        joined = b"\0".join([*texts, b""])
        plain = joined.decode()
    points = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    offset = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=offset[1:])
    at = np.cumsum([len(t) + 1 for t in texts]) - 1
    ends = np.searchsorted(offset, at)
    starts = token_starts(points, ends)
    cuts = pa.py_buffer(np.append(offset[starts], len(joined)).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, cuts, pa.py_buffer(joined)]), np.searchsorted(starts, ends)


class Cache(dict):
    """Ids (32-bit integers) by piece, made at the first use; those of long pieces are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: bytes) -> bytes:
        ids = array("i", self.make(piece)).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


CACHE = 1_000_000  # pieces that a worker keeps merged


class ByteBPE:
    """``ranks_path``: a file of lines ``base64-token rank``."""

    def __init__(self, ranks_path: str, cache: int = CACHE):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocab: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocab[rank] = token
        self.cache = Cache(self._merge)
        self.limit = cache

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """Merges the adjacent pair of least rank, the leftmost first, until no pair is in the vocabulary."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        far = len(ranks)
        pairs = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            least = min(pairs)
            if least == far:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], far)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and linked parts: n log n for very long pieces."""
        import heapq

        ranks = self.ranks
        part: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        right = list(range(1, len(part))) + [-1]
        left = list(range(-1, len(part) - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(part) - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if part[i] is not None else -1
            if j < 0 or part[i] is not a or part[j] is not b:
                continue
            part[i], part[j] = a + b, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := ranks.get(part[x] + part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return tuple(ranks[p] for p in part if p is not None)

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry ends the last). Each different piece is merged once."""
        if len(self.cache) > self.limit:
            self.cache.clear()
        pieces, marks = pre_tokens(texts)
        coded = pieces.dictionary_encode()
        each = list(map(self.cache.__getitem__, coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        known = np.frombuffer(b"".join(each), np.int32)
        code = coded.indices.to_numpy()
        length = size[code]
        length[marks] = 0
        before = np.zeros(len(code) + 1, np.int64)
        np.cumsum(length, out=before[1:])
        place = np.repeat((np.cumsum(size) - size)[code] - before[:-1], length)
        place += np.arange(before[-1])
        return known[place], np.append(0, before[marks])

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text.encode("utf-8", "surrogatepass")])[0].tolist()

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens in a row, where each begins, and its size."""
        size = np.array([len(t) for t in self.vocab])
        return np.frombuffer(b"".join(self.vocab), np.uint8), np.cumsum(size) - size, size

    def offsets(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For the ids of texts that begin ``at`` these places the byte of its text at which each token begins."""
        before = np.append(0, np.cumsum(self.spelled[2][ids]))
        return (before[:-1] - np.repeat(before[at[:-1]], np.diff(at))).astype(np.int32)

    def decode_texts(self, ids: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each text, every token put at its offset."""
        raw, begin, size = self.spelled
        size, last = size[ids], at[1:][np.diff(at) > 0] - 1
        length = np.zeros(len(at) - 1, np.int64)
        length[np.diff(at) > 0] = offsets[last] + size[last]
        start = np.append(0, np.cumsum(length))
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out = np.zeros(start[-1], np.uint8)
        out[np.repeat(offsets + np.repeat(start[:-1], np.diff(at)), size) + step] = raw[np.repeat(begin[ids], size) + step]
        whole = out.tobytes()
        return [whole[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


@lru_cache(2)
def coder(ranks_path: str, cache: int = CACHE) -> ByteBPE:
    return ByteBPE(ranks_path, cache)


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True, cache: int = CACHE) -> DataFrame:
    """``<id_col>, ids array<int>, offsets array<int>`` of every row: the tokens and the byte of the text at which each begins (not without ``offsets``). A worker keeps ``cache`` pieces merged at most.

    Null and empty texts have no ids. Bytes that aren't UTF-8 count as U+FFFD,
    offsets too. Repeated rows stay repeated; extra columns are ignored; an
    empty table gives an empty one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, cache)
        for batch in batches:
            texts, keys = utf8(batch.column(1)), batch.column(0)
            for a, b in chunks(texts):
                ids, at = bpe.encode_texts(texts[a:b])
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in (ids, *([bpe.offsets(ids, at)] if offsets else []))]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *lists], ["id", "ids", "offsets"][: 1 + len(lists)])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(encode), "id long, ids array<int>" + ", offsets array<int>" * offsets).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """``<id_col>, ids, decoded binary``: every token's bytes put at its offset; null ids decode to nothing."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path)
        for batch in batches:
            lists = batch.column(1)
            at = np.append(0, np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy()))
            ids, offsets = (pa.compute.list_flatten(batch.column(k)).to_numpy() for k in (1, 2))
            texts = pa.array(bpe.decode_texts(ids, offsets, at), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, texts], ["id", "ids", "decoded"])

    columns = [F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), F.col(offsets_col).alias("offsets")]
    return encoded.select(*columns).mapInArrow(lean(decode), "id long, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = decode_documents(encode_documents(docs, path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
