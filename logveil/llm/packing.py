"""Packing token ids into sequences of bounded length by bounded-space best fit.

Every task packs the documents it reads as they come. A document's full
sequences leave at once; what is left of it goes into the open window that it
fills best. At most ``OPEN`` windows are open: where none fits, another is
opened, and where no more may be, the fullest is topped up with the head of the
piece and leaves. At the end of a task the windows that are still open are
joined, so that one at most is short. Those of up to ``MERGED`` tasks are then
joined again, and so on until one is left of all: rounds grow with the logarithm
of the number of tasks, and each group holds at most ``MERGED`` windows. The
last one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, lean, shared_dir
from .token_store import encode_documents

LENGTH = 4096
OPEN = 64  # windows of a task that are open at once
MERGED = 64  # short windows that are joined in one group
AT_ONCE = 256  # sequences of an output batch
PIECES = "doc_id long, start long, length long, doc_tokens long, part long, sequence long, offset long, short boolean, ids binary"

Piece = tuple[int | None, int, int, np.ndarray]  # doc_id, start, doc_tokens, ids


class Packer:
    """Best fit over at most ``most`` open windows of ``length`` ids; ``sealed`` collects what leaves."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most = length, most
        self.open: dict[int, list[Piece]] = {}
        self.gaps: list[tuple[int, int]] = []  # free ids and number of each open window, ascending
        self.sealed: list[list[Piece]] = []
        self.number = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.length:
            self.sealed.append([(doc_id, at, n, ids[at : at + self.length].copy())])
            at += self.length
        while at < n:
            at += self._place((doc_id, at, n, ids[at:]))

    def _place(self, piece: Piece) -> int:
        """Puts the piece, or its head, into a window; returns how many ids went."""
        doc_id, at, n, ids = piece
        k = bisect_left(self.gaps, (len(ids), -1))
        if k < len(self.gaps):
            gap, window = self.gaps.pop(k)
        elif len(self.gaps) < self.most:
            gap, window = self.length, self.number
            self.number += 1
            self.open[window] = []
        else:
            gap, window = self.gaps.pop(0)
        taken = min(gap, len(ids))
        self.open[window].append((doc_id, at, n, ids[:taken].copy()))  # else it would hold the whole batch
        if taken == gap:
            self.sealed.append(self.open.pop(window))
        else:
            insort(self.gaps, (gap - taken, window))
        return taken

    def leave(self) -> list[list[Piece]]:
        out, self.sealed = self.sealed, []
        return out

    def rest(self) -> list[Piece]:
        """What is in the open windows, the fullest first; none is open then."""
        out = [p for _, window in self.gaps for p in self.open[window]]
        self.open, self.gaps = {}, []
        return out


def joined(pieces: list[Piece], length: int) -> tuple[list[list[Piece]], list[Piece]]:
    """The pieces in a row, cut into full sequences, and what is left of them."""
    full: list[list[Piece]] = []
    now: list[Piece] = []
    free = length
    for doc_id, at, n, ids in pieces:
        while len(ids):
            taken = min(free, len(ids))
            now.append((doc_id, at, n, ids[:taken]))
            at, ids, free = at + taken, ids[taken:], free - taken
            if not free:
                full.append(now)
                now, free = [], length
    return full, now


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in a row, cut into sequences whose lengths are powers of two, the longest first."""
    left = sum(len(p[3]) for p in pieces)
    out = []
    while left:
        size = 1 << (left.bit_length() - 1)
        full, rest = joined(pieces, size)
        out.append(full[0])
        pieces = [p for s in full[1:] for p in s] + rest
        left -= size
    return out


def _batch(sequences: list[list[Piece]], part: int, first: int, short: bool) -> pa.RecordBatch:
    rows = [(p, first + k, short) for k, s in enumerate(sequences) for p in s]
    offsets = [o for s in sequences for o in np.cumsum([0, *(len(p[3]) for p in s)])[:-1].tolist()]
    pieces = [p for p, _, _ in rows]
    long = pa.int64()
    columns = [
        pa.array([p[0] for p in pieces], long),
        pa.array([p[1] for p in pieces], long),
        pa.array([len(p[3]) for p in pieces], long),
        pa.array([p[2] for p in pieces], long),
        pa.array([part] * len(rows), long),
        pa.array([k for _, k, _ in rows], long),
        pa.array(offsets, long),
        pa.array([s for _, _, s in rows], pa.bool_()),
        pa.array([p[3].astype("<u4").tobytes() for p in pieces], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])


def _packed(coded: DataFrame, length: int, most: int) -> DataFrame:
    """Pieces of ``coded (doc_id, ids)``, task by task; at most one sequence of a task is short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer, count = Packer(length, most), 0
        for batch in batches:
            lists = batch.column(1)
            flat, at = np.asarray(lists.values), np.asarray(lists.offsets).tolist()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                packer.add(doc_id, flat[a:b])
                if len(packer.sealed) >= AT_ONCE:
                    out = packer.leave()
                    for k in range(0, len(out), AT_ONCE):
                        yield _batch(out[k : k + AT_ONCE], part, count + k, False)
                    count += len(out)
        full, left = joined(packer.rest(), length)
        full = packer.leave() + full
        for k in range(0, len(full), AT_ONCE):
            yield _batch(full[k : k + AT_ONCE], part, count + k, False)
        if left:
            yield _batch([left], part, count + len(full), True)
        give_back()

    return coded.select("doc_id", "ids").mapInArrow(lean(run), PIECES)


def _merged(short: DataFrame, length: int, last: bool) -> DataFrame:
    """The short sequences of ``MERGED`` parts each, joined; with ``last`` those of all, cut at powers of two in the end."""

    def run(key, group):
        group = group.sort_by([("part", "ascending"), ("sequence", "ascending"), ("offset", "ascending")])
        ids = [np.frombuffer(b, "<u4") for b in group.column("ids").to_pylist()]
        pieces = list(zip(group.column("doc_id").to_pylist(), group.column("start").to_pylist(), group.column("doc_tokens").to_pylist(), ids, strict=True))
        full, left = joined(pieces, length)
        part = key[0].as_py()
        out = [_batch(full, part, 0, False)]
        if left:
            out.append(_batch(powers(left), part, len(full), False) if last else _batch([left], part, len(full), True))
        return pa.Table.from_batches(out)

    return short.groupBy(F.floor(F.col("part") / MERGED).alias("group")).applyInArrow(run, PIECES)


def packed(coded: DataFrame, length: int = LENGTH, open_windows: int = OPEN) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` of each piece of ``coded (doc_id, ids array<int>)``.

    ``ids`` are little-endian unsigned 32-bit integers. Every id lies in one
    piece; a sequence has ``length`` ids, but for the last ones, which are cut
    at powers of two, so that nothing needs padding. A document without ids has
    no piece. Null and repeated ``doc_id``s are packed row by row, so pieces of
    rows that share one can't be told apart. An empty table gives no pieces.
    ``sequence_id`` is the round, the task and a number within it in one long.
    """
    if length < 1 or open_windows < 1:
        raise ValueError("a sequence holds one id at least, and one window at least is open")
    spark, path = coded.sparkSession, shared_dir(coded.sparkSession)
    stored = lambda k: spark.read.schema(PIECES).parquet(f"{path}/round={k}")
    _packed(coded, length, open_windows).write.option("compression", "zstd").parquet(f"{path}/round=0")
    k = 0
    while True:
        short = stored(k).where("short")
        most = short.agg(F.max("part")).first()[0]
        if most is None:
            break
        k += 1
        _merged(short, length, most < MERGED).write.option("compression", "zstd").parquet(f"{path}/round={k}")
    rounds = [stored(i).where("not short").withColumn("round", F.lit(i).cast("long")) for i in range(k + 1)]
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    number = F.shiftleft("round", 58) + F.shiftleft("part", 32) + F.col("sequence")
    return out.select("doc_id", "start", "length", "doc_tokens", number.alias("sequence_id"), "offset", "ids")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = None, length: int = LENGTH, open_windows: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all ``docs``, encoded by a file of the tokenizers library; ``end_id`` closes every document.

    Null and empty texts have only the end id (without one, no piece); extra
    columns are ignored.
    """
    return packed(encode_documents(docs, tokenizer, end_id, id_col, text_col), length, open_windows)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
