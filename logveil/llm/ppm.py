"""Code length of documents by prediction by partial matching.

A text is its tokens, each followed by one space, and one end (byte 10, which
no token has). Every byte is predicted from the ``order`` bytes before it,
across tokens; before a text stand ends. The model is a trie of byte contexts
over all bytes of all training documents, of the same order at every size.

The longest context has the counts of its symbols; a shorter one counts a
symbol once for each longer context that met it (update exclusion: a symbol
reaches the shorter context only where the longer one didn't know it). Escapes
follow method D: of q distinct symbols with T counts in all, one seen c times
has (c - 1/2) / T and the escape q / 2T. After an escape, what the longer
context knows is excluded from the shorter one. Below order 0 all bytes not
yet excluded are equally likely.

The trie is never in one place. Documents are cut to chunks of bounded size,
and a chunk to its distinct grams (context and symbol) with their counts, dealt
to parts by the three bytes nearest to the symbol. A part sums the grams of all
chunks, holds every context of three and more bytes that ends in its own, and
gives each chunk back the log probability of its grams. Contexts of fewer than
three bytes span parts; their table has at most 2 ** 24 entries at any size and
is sent to all. Where three bytes are crowded (``CROWD`` bytes of text stand
behind them), their own context is sent to all as well and their grams are
dealt by four bytes, and so on. A context is crowded only where it has at least
a share of 2 ** -17 of all text, so there are at most 2 ** 17 on a level. Token
counts for the smoothed word baseline travel the same way, by the token's
64-bit hash.

A text longer than a chunk is cut behind a token; each piece knows the bytes
before it, and the pieces' sums are added up at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _FOLD, _SPACE, bucket, give_back, lean, mix, run_hashes, utf8, written

ORDER = 6  # bytes of context; seven bytes of context and symbol leave one of 64 bits' eight
TOP = 2  # contexts up to here are sent to all parts
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 50_000
PART_BYTES = 16 << 20  # text whose grams make a part
CROWD = 64 << 20  # bytes behind one context, from which on it is dealt by one byte more
END, GAP = 10, 32
HALF = 0.5  # what method D takes off every count
ID, FLAGS, SIZE, SPACES, BEFORE, WHOLE = range(6)  # what is known of each text of a chunk
TRAINED, HAS_ID, GOES_ON = 1, 2, 4
_FOLDED, _BLANK = _FOLD.tobytes(), _SPACE.tobytes()
_NOTHING = int.from_bytes(bytes([END] * ORDER))  # the bytes before a text, nearest in the lowest byte


def canonical(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lower-cased tokens, each with a space after it, and an end; and the bytes of each text."""
    joined = bytearray(b" \n").join([*texts, b""]).translate(_FOLDED)
    ends = np.cumsum([len(t) + 2 for t in texts], dtype=np.int64) - 1
    space = np.frombuffer(joined.translate(_BLANK), bool)
    raw = np.frombuffer(joined, np.uint8)
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[ends] = True
    raw[space] = GAP
    raw[ends] = END
    return raw[keep], _numbers(keep, ends + 1)


def _numbers(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many are true up to each of ``ends`` since the one before."""
    return np.array([np.count_nonzero(mask[a:b]) for a, b in zip((0, *ends), ends, strict=False)], np.int64)


def cut(raw: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of about ``limit`` bytes of one text start, each behind a token, and the ``ORDER`` bytes before each as a number."""
    gaps = np.flatnonzero(raw[:-2] == GAP) + 1
    wanted = np.arange(limit, len(raw) - 1, limit)
    at = np.searchsorted(gaps, wanted)
    starts = np.unique(np.append(0, gaps[at[at < len(gaps)]]))
    before = [_NOTHING, *(int.from_bytes(raw[: a][-ORDER:].tobytes().rjust(ORDER, bytes([END]))) for a in starts[1:].tolist())]
    return starts, np.array(before, np.int64)


def grams(raw: np.ndarray, size: np.ndarray, order: int, before: np.ndarray | None = None) -> np.ndarray:
    """For every byte a number: the ``order`` bytes before it, nearest first, and itself in the lowest byte."""
    owner = np.repeat(np.arange(1, len(size) + 1, dtype=np.int32), size)
    place = np.arange(len(raw)) + order * owner
    padded = np.full(len(raw) + order * len(size), END, np.uint64)
    padded[place] = raw
    inner = np.flatnonzero(before != _NOTHING) if before is not None else ()
    for i in inner:
        first = int(size[:i].sum()) + order * int(i)
        padded[first : first + order] = [int(before[i]) >> 8 * (order - 1 - k) & 255 for k in range(order)]
    key = padded.copy()
    for k in range(1, order + 1):
        key[k:] |= padded[:-k] << np.uint64(8 * (order + 1 - k))
    return key[place]


def _starts(ordered: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def distinct(key: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers below 2 ** 63 and how often each is ``trained``."""
    packed = np.sort((key << np.uint64(1)) | trained.astype(np.uint64))
    value = packed >> np.uint64(1)
    at = _starts(value)
    return value[at], np.add.reduceat(packed & np.uint64(1), at).astype(np.int64) if len(at) else np.zeros(0, np.int64)


def tokens(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every token (ends aside)."""
    word = np.ones(len(raw) + 1, bool)
    word[0] = False
    word[1:] = (raw != GAP) & (raw != END)
    starts = np.flatnonzero(word[1:] & ~word[:-1])
    ends = np.flatnonzero(raw == GAP)
    return run_hashes(raw, starts, ends), np.searchsorted(np.cumsum(size), starts, side="right")


def pack(values: np.ndarray) -> bytes:
    """Numbers as byte planes behind their count, compressed; ascending ones as differences."""
    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(len(flat), flat.itemsize).T
    return len(flat).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(pa.py_buffer(blob).slice(4), decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def _steps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=np.uint64(0))


def _shorter(key: np.ndarray) -> np.ndarray:
    """The same symbol in the context without its farthest byte."""
    return ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255))


def _found(table: np.ndarray, value: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(key), value.dtype)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, value[at], 0)


def _escape(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """log10 of a symbol in a context with these counts left, ``tail`` below it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > 0, np.log10((count - HALF) / total), np.where(kinds > 0, np.log10(HALF * kinds / total), 0.0) + tail)


class Top:
    """Contexts that are sent to all: those of at most ``TOP`` bytes, from the grams of ``TOP`` + 1 bytes and how many longer contexts met each, and the crowded ones of each number of bytes from there on (``crowds``, with their grams and numbers in ``longer``)."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, crowds: list[np.ndarray] = (), longer: list[tuple[np.ndarray, np.ndarray]] = ()):
        self.crowds = list(crowds)
        by = np.argsort(gram)
        self.gram, self.count = [gram[by].astype(np.uint64)], [count[by].astype(np.int64)]
        for _ in range(TOP):
            key = np.sort(_shorter(self.gram[0]))
            at = _starts(key)
            self.gram.insert(0, key[at])
            self.count.insert(0, np.diff(np.append(at, len(key))))
        for gram, count in longer:
            by = np.argsort(gram)
            self.gram.append(gram[by].astype(np.uint64))
            self.count.append(count[by].astype(np.int64))
        self.context, self.total, self.kinds, self.below = [], [], [], []
        for k in range(len(self.gram)):
            context = self.gram[k] >> np.uint64(8)
            at = _starts(context)
            add = (lambda v, at=at: np.add.reduceat(v, at)) if len(at) else (lambda v: np.zeros(0, np.int64))
            self.context.append(context[at])
            self.total.append(add(self.count[k]))
            self.kinds.append(np.diff(np.append(at, len(context))))
            self.below.append(add(_found(self.gram[k - 1], self.count[k - 1], _shorter(self.gram[k]))) if k else np.zeros(len(at), np.int64))

    def state(self, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of grams of ``depth`` + 1 bytes: count, total and kinds of the context, and log10 of the symbol after an escape from it."""
        keys = [key]
        for _ in range(depth):
            keys.insert(0, _shorter(keys[0]))
        used = int(self.kinds[0][0]) if len(self.kinds[0]) else 0
        tail = np.full(len(key), -np.log10(max(256 - used, 1)))
        for k in range(depth):
            count, total, kinds = self._at(k, keys[k])
            above, context = k + 1, keys[k + 1] >> np.uint64(8)
            tail = _escape(count, total - _found(self.context[above], self.below[above], context), kinds - _found(self.context[above], self.kinds[above], context), tail)
        return *self._at(depth, key), tail

    def _at(self, k: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        context = key >> np.uint64(8)
        return _found(self.gram[k], self.count[k], key), _found(self.context[k], self.total[k], context), _found(self.context[k], self.kinds[k], context)


def depths(gram: np.ndarray, order: int, crowds: list[np.ndarray]) -> np.ndarray:
    """How many bytes of the context of each gram are sent to all: ``TOP``, and one more for each crowded context it ends in."""
    depth = np.full(len(gram), TOP, np.uint8)
    for k, crowd in enumerate(crowds, TOP + 1):
        inner = np.flatnonzero(depth == k - 1)
        depth[inner[np.isin(gram[inner] >> np.uint64(8 * (order + 1 - k)), crowd)]] = k
    return depth


def log10_of(gram: np.ndarray, count: np.ndarray, order: int, top: Top) -> np.ndarray:
    """log10 probability of the last byte of each of the sorted distinct grams, of which each context that isn't sent to all is there whole or not at all."""
    depth = depths(gram, order, top.crowds)
    out = np.empty(len(gram))
    for d in np.unique(depth).tolist():
        at = np.flatnonzero(depth == d)
        out[at] = _log10_below(gram[at], count[at], order, top, d)
    return out


def _log10_below(gram: np.ndarray, count: np.ndarray, order: int, top: Top, depth: int) -> np.ndarray:
    key, counts, up = [gram], [count], []
    for _ in range(order - depth):
        shorter, back = np.unique(_shorter(key[0]), return_inverse=True)
        key.insert(0, shorter)
        up.insert(0, back)
        counts.insert(0, np.bincount(back, counts[0] > 0, len(shorter)).astype(np.int64))
    count, total, kinds, tail = top.state(key[0], depth)
    for k in range(1, order - depth + 1):
        back = up[k - 1]
        context = key[k] >> np.uint64(8)
        at = _starts(context)
        sizes = np.diff(np.append(at, len(context)))
        seen = counts[k] > 0

        def whole(v: np.ndarray, at=at, sizes=sizes) -> np.ndarray:
            return np.repeat(np.add.reduceat(v, at), sizes) if len(at) else v

        here_kinds = whole(seen.astype(np.int64))
        tail = _escape(count[back], total[back] - whole(np.where(seen, count[back], 0)), kinds[back] - here_kinds, tail[back])
        count, total, kinds = counts[k], whole(counts[k]), here_kinds
    return _escape(count, total, kinds, tail)


def chunk_table(docs: DataFrame) -> DataFrame:
    """``chunk, heads, text, size, tokens, ends`` of ``docs (id, trained, text)``: canonical texts (and pieces of those longer than a chunk) one after another, packed; for each its id, flags, bytes, tokens, the bytes before it, and for a piece a number of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = rows = made = texts = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, rows, made
            head = np.concatenate([h for h, _ in kept])
            text = np.concatenate([t for _, t in kept])
            trained = _trained(head)
            kept.clear()
            ends = trained & (head[:, FLAGS] & GOES_ON == 0)
            row = [(part << 24) | made, head.tobytes(), pack(text), len(text), int(head[trained, SPACES].sum()), int(ends.sum())]
            held, rows, made = 0, 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["chunk", "heads", "text", "size", "tokens", "ends"])

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                piece = batch.slice(i, 200)
                text, size = canonical(utf8(piece.column(2)))
                ids, flags = piece.column(0), piece.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                flags += ids.is_valid().to_numpy(zero_copy_only=False) * HAS_ID
                plain = np.broadcast_to(np.array([_NOTHING, -1], np.int64), (len(size), 2))
                head = np.column_stack([ids.fill_null(0).to_numpy(), flags, size, _numbers(text == GAP, np.cumsum(size)), plain])
                bounds = np.append(0, np.cumsum(size))
                done = 0
                for j in np.flatnonzero(size > CHUNK_BYTES).tolist():  # a text of its own pieces, and what stands before it
                    if j > done:
                        kept.append((head[done:j], text[bounds[done] : bounds[j]]))
                    if kept:
                        yield flush()
                    long = text[bounds[j] : bounds[j + 1]]
                    starts, before = cut(long, CHUNK_BYTES)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(long)], strict=True)):
                        one = head[j : j + 1].copy()
                        one[0, [SIZE, SPACES, BEFORE, WHOLE]] = b - a, np.count_nonzero(long[a:b] == GAP), before[k], (part << 32) | texts
                        one[0, FLAGS] |= GOES_ON * (b < len(long))
                        kept.append((one, long[a:b]))
                        yield flush()
                    texts, done = texts + 1, j + 1
                if done < len(size):
                    kept.append((head[done:], text[bounds[done] :]))
                    held, rows = held + len(kept[-1][1]), rows + len(kept[-1][0])
                if held >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                    yield flush()
        if kept:
            yield flush()

    return docs.select("id", "trained", "text").mapInArrow(lean(run), "chunk long, heads binary, text binary, size long, tokens long, ends long")


def _opened(heads: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(heads, np.int64).reshape(-1, 6), unpack(text, "u1")


def _trained(head: np.ndarray) -> np.ndarray:
    return head[:, FLAGS] & TRAINED == TRAINED


class Dealt:
    """The distinct grams and token hashes of a chunk in the order of the parts they go to."""

    def __init__(self, head: np.ndarray, raw: np.ndarray, order: int, parts: int, crowds: list[np.ndarray]):
        size, trained = head[:, SIZE], _trained(head)
        self.gram, self.gram_n = distinct(grams(raw, size, order, head[:, BEFORE]), np.repeat(trained, size))
        depth = depths(self.gram, order, crowds).astype(np.uint64)
        nearest = (self.gram >> (np.uint64(8) * (np.uint64(order) - depth))) | (depth - np.uint64(TOP) << np.uint64(60))
        self.gram_order, self.gram_cut = self._deal(mix(nearest), parts)
        value, owner = tokens(raw, size)
        by = np.argsort(value)
        value, self.owner = value[by], owner[by]
        at = _starts(value)
        self.word, self.times = value[at], np.diff(np.append(at, len(value)))
        self.word_n = np.add.reduceat(trained[self.owner], at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        self.word_order, self.word_cut = self._deal(mix(self.word), parts)

    @staticmethod
    def _deal(hashed: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        part = (hashed % np.uint64(parts)).astype(np.uint16 if parts <= 65536 else np.uint32)
        return np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


def deal(chunks: DataFrame, order: int, parts: int, crowds: list[np.ndarray]) -> DataFrame:
    """``part, chunk, gram, gram_n, word, word_n``: packed distinct grams and token hashes of a chunk with their counts in training texts."""
    names = ["part", "chunk", "gram", "gram_n", "word", "word_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, heads, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                d = Dealt(*_opened(heads.as_py(), text.as_py()), order, parts, crowds)
                rows = []
                for p in range(parts):
                    g = d.gram_order[d.gram_cut[p] : d.gram_cut[p + 1]]
                    w = d.word_order[d.word_cut[p] : d.word_cut[p + 1]]
                    if len(g) or len(w):
                        rows.append((p, chunk.as_py(), pack(_steps(d.gram[g])), pack(d.gram_n[g].astype(np.uint32)), pack(_steps(d.word[w])), pack(d.word_n[w].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
        give_back()

    return chunks.select("chunk", "heads", "text").mapInArrow(run, "part long, chunk long, gram binary, gram_n binary, word binary, word_n binary")


def _summed(blobs: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct numbers of all blobs, their summed counts, and for each blob where its numbers are among them."""
    each = [np.cumsum(unpack(b, "u8"), dtype=np.uint64) for b in blobs]
    value = np.concatenate(each)
    value = np.sort(value)
    value = value[_starts(value)]
    total, places = np.zeros(len(value), np.int64), []
    for key, n in zip(each, counts, strict=True):
        at = np.searchsorted(value, key)
        total[at] += unpack(n, "u4")
        places.append(at.astype(np.uint32))
    return value, total, places


def judge(dealt: DataFrame, order: int, sent) -> DataFrame:
    """``chunk, part, scores, counts``: what ``deal`` gave, as log10 probabilities and as counts of all; with a row of chunk ``-1 - part`` for the number of distinct trained tokens."""

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        blobs = {c: [b.as_py() for b in group.column(c)] for c in ("gram", "gram_n", "word", "word_n")}
        key, total, places = _summed(blobs["gram"], blobs["gram_n"])
        score = log10_of(key, total, order, sent.value).astype(np.float32)
        scores = [pack(score[at]) for at in places]
        key, total, places = _summed(blobs["word"], blobs["word_n"])
        kinds = int((total > 0).sum())
        counts = [pack(total[at]) for at in places]
        give_back()
        chunks = [*group.column("chunk").to_pylist(), -1 - part]
        return pa.table({"chunk": chunks, "part": pa.array([part] * len(chunks), pa.int64()), "scores": [*scores, b""], "counts": [*counts, pack(np.array([kinds], np.int64))]})

    return dealt.groupBy("part").applyInArrow(run, "chunk long, part long, scores binary, counts binary")


def _document_scores(raw: np.ndarray, size: np.ndarray, before: np.ndarray, gram: np.ndarray, score: np.ndarray, order: int) -> np.ndarray:
    """Sums of the scores of each text's grams, 256 texts at once: a gram's free byte holds the text."""
    out = np.zeros(len(size))
    bounds = np.append(0, np.cumsum(size))
    for a in range(0, len(size), 256):
        own = size[a : a + 256]
        key = grams(raw[bounds[a] : bounds[a + len(own)]], own, order, before[a : a + len(own)]) << np.uint64(8)
        key |= np.repeat(np.arange(len(own), dtype=np.uint64), own)
        key.sort()
        at = _starts(key)
        times = np.diff(np.append(at, len(key)))
        key = key[at]
        found = score[np.searchsorted(gram, key >> np.uint64(8))]
        out[a : a + len(own)] = np.bincount((key & np.uint64(255)).astype(np.intp), found * times, len(own))
    return out


def gather(chunks: DataFrame, judged: DataFrame, order: int, parts: int, end_n: int, crowds: list[np.ndarray]) -> DataFrame:
    """``id, trained, n_tokens, n_known, logs, score, whole`` of each text or piece (null, but for pieces the number of their text), and rows without tokens that hold distinct trained tokens in ``n_known``."""
    schema = pa.schema([("id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("whole", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        counts = [unpack(b.as_py(), "i8") for b in right.column("counts")]
        if not left.num_rows:
            kinds = int(sum(c[0] for c in counts))
            return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, 0, kinds, 0.0, 0.0, None), schema, strict=True)], schema=schema)
        head, raw = _opened(left.column("heads")[0].as_py(), left.column("text")[0].as_py())
        n, size, closed = len(head), head[:, SIZE], head[:, FLAGS] & GOES_ON == 0
        d = Dealt(head, raw, order, parts, crowds)
        score = np.empty(len(d.gram), np.float32)
        score[d.gram_order] = np.concatenate([unpack(b.as_py(), "f4") for b in right.column("scores")])
        found = np.empty(len(d.word), np.int64)
        found[d.word_order] = np.concatenate(counts)

        def total(value: np.ndarray) -> np.ndarray:
            return np.bincount(d.owner, np.repeat(value, d.times), n)

        result = [
            pa.array(head[:, ID], mask=head[:, FLAGS] & HAS_ID == 0),
            pa.array(_trained(head)),
            pa.array(head[:, SPACES] + closed),
            pa.array(total((found > 0).astype(np.float64)).astype(np.int64) + (closed & (end_n > 0))),
            pa.array(total(np.log10(found + 0.1)) + closed * np.log10(end_n + 0.1)),
            pa.array(_document_scores(raw, size, head[:, BEFORE], d.gram, score, order)),
            pa.array(head[:, WHOLE], mask=head[:, WHOLE] < 0),
        ]
        give_back()
        return pa.Table.from_arrays(result, schema=schema)

    left = chunks.select("chunk", "heads", "text")
    return left.groupBy("chunk").cogroup(judged.groupBy("chunk")).applyInArrow(run, "id long, trained boolean, n_tokens long, n_known long, logs double, score double, whole long")


def top_counts(chunks: DataFrame, length: int = TOP, within: np.ndarray | None = None) -> DataFrame:
    """``gram, n``: grams of ``length`` bytes of context (of those in ``within``, where given) and a symbol, and the number of contexts one byte longer that met each; at most 256 rows a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for heads, text in zip(batch.column(0), batch.column(1), strict=True):
                head, raw = _opened(heads.as_py(), text.as_py())
                trained = _trained(head)
                raw = raw[np.repeat(trained, head[:, SIZE])]
                key = grams(raw, head[trained, SIZE], length + 1, head[trained, BEFORE])
                if within is not None:
                    key = key[np.isin(key >> np.uint64(16), within)]
                key = np.sort(key.astype(np.uint32 if length <= TOP else np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key[_starts(key)].astype(np.int64))], ["gram"])
        give_back()

    met = chunks.select("heads", "text").mapInArrow(run, "gram long").distinct()
    shorter = F.shiftleft(F.shiftright("gram", 16), 8).bitwiseOR(F.col("gram").bitwiseAND(F.lit(255)))
    return met.groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def crowded(chunks: DataFrame, length: int, size: int, within: np.ndarray | None) -> np.ndarray:
    """Sorted contexts of ``length`` bytes (of which one byte less is in ``within``) that stand before half of ``CROWD`` bytes, or of 2 ** -16 of all, at least; none with the whole of it is missed.

    A chunk tells only those that reach half of that share in it: what it
    leaves out adds up to less than half of the bound.
    """
    bound = max(CROWD, size >> 16)
    if size < bound:
        return np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for heads, text in zip(batch.column(0), batch.column(1), strict=True):
                head, raw = _opened(heads.as_py(), text.as_py())
                key = grams(raw, head[:, SIZE], length, head[:, BEFORE]) >> np.uint64(8)
                if within is not None:
                    key = key[np.isin(key >> np.uint64(8), within)]
                key = np.sort(key.astype(np.uint32 if length <= TOP + 1 else np.uint64))
                at = _starts(key)
                n = np.diff(np.append(at, len(key)))
                often = n >= bound / size / 2 * len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(key[at[often]].astype(np.int64)), pa.array(n[often])], ["context", "n"])
        give_back()

    told = chunks.select("heads", "text").mapInArrow(run, "context long, n long")
    found = told.groupBy("context").agg(F.sum("n").alias("n")).where(F.col("n") >= bound / 2).toArrow()
    return np.sort(found.column("context").to_numpy()).astype(np.uint64)


def _arrays(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = counted.toArrow()
    return got.column("gram").to_numpy(), got.column("n").to_numpy()


def score_documents(docs: DataFrame, trained, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``<id_col>, trained, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``trained``: a Boolean column, true for rows to learn from. Null and empty
    texts are the end alone. Rows without an id are scored and, where
    ``trained`` is null, not learnt from. Repeated rows each count and are each
    returned; ties don't arise. Extra columns are ignored; an empty table gives
    an empty one. Without a row to learn from every byte has 1/256. ``order``
    is 3 to 6. A very long text is cut to pieces of a chunk's size behind a token;
    only a single token longer than a chunk stays whole.
    """
    if not TOP < order <= ORDER:
        raise ValueError(f"order {order} is not in {TOP + 1} to {ORDER}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(trained, F.lit(False)).alias("trained"), F.col(text_col).alias("text"))
    chunks = written(chunk_table(rows))
    facts = chunks.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("ends").alias("ends")).first()
    parts = max(1, -(-(facts["size"] or 0) // PART_BYTES))
    ends = facts["ends"] or 0
    total = (facts["tokens"] or 0) + ends
    crowds: list[np.ndarray] = []
    longer = []
    for length in range(TOP + 1, order):
        crowd = crowded(chunks, length, facts["size"] or 0, crowds[-1] if crowds else None)
        if not len(crowd):
            break
        crowds.append(crowd)
        longer.append(_arrays(top_counts(chunks, length, crowd)))
    sent = spark.sparkContext.broadcast(Top(*_arrays(top_counts(chunks)), crowds, longer))
    judged = judge(deal(chunks, order, parts, crowds), order, sent)
    out = written(gather(chunks, judged, order, parts, ends, crowds))
    kinds = (out.where("n_tokens = 0").agg(F.sum("n_known")).first()[0] or 0) + (ends > 0)
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + 0.1 * (kinds + 1))))
    texts = out.where("n_tokens > 0")
    numbers = ("n_tokens", "n_known", "logs", "score")
    joined = texts.where("whole is not null").groupBy("whole").agg(F.first("id").alias("id"), F.first("trained").alias("trained"), *(F.sum(c).alias(c) for c in numbers))
    texts = texts.where("whole is null").drop("whole").unionByName(joined.drop("whole"))
    return texts.select(F.col("id").alias(id_col), "trained", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_documents(docs, bucket("doc_id", 10) != 0)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
