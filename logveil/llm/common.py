"""What the operators of this folder share: shared storage, token hashes, batching.

Tokens here are the byte runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text after
lower-casing ``A-Z``; a null text counts as the empty one everywhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all machines see; where that is unset (tests), one of this machine."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="logveil-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    path = f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"
    if _TRACKED:
        _FOLDERS.append(path)
    return path


_TRACKED: list[bool] = []
_FOLDERS: list[str] = []  # given out within ``tracked`` and not removed since


@contextmanager
def tracked() -> Iterator[None]:
    """Folders that are given out within it are removed by the next ``cleared``."""
    _TRACKED.append(True)
    try:
        yield
    finally:
        _TRACKED.pop()


def cleared(docs: DataFrame) -> DataFrame:
    """``docs``, after the removal of all tracked folders that it doesn't read.

    For jobs that go stage by stage over written tables: what the stages before
    left is of no use once their rows are written.
    """
    held = [unquote(f) for f in docs.inputFiles()]
    spark, kept = docs.sparkSession, []
    for path in _FOLDERS:
        if any(path in f for f in held):
            kept.append(path)
            continue
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _FOLDERS[:] = kept
    return docs


FILE_ROWS = 100_000


def written(df: DataFrame, rows: int | None = None, each: int = FILE_ROWS, **options: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: cuts lineage and survives the loss of any executor.

    Where it is known that there are at most ``rows``, a task takes about
    ``each`` of them if there are more tasks than that needs: every file costs
    the executor's JVM several processes on a local disk, however few rows it has.
    """
    path = shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a long in ``name`` that no two rows share and that stays the same however often a part is read.

    Rows of Parquet files are numbered by their file and their place in it,
    which needs no copy. Other rows are written with their number.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        try:
            names = sorted(r[0] for r in df.select(file).distinct().collect())  # files, which the driver has listed anyway
        except AnalysisException:  # files of a kind that has no such columns
            names = None
        if names is not None and len(names) < 1 << 23:
            files = df.sparkSession.createDataFrame(list(enumerate(names)), "file_no long, file_name string")
            keyed = df.withColumns({"name of its file": file, "place in its file": at})
            known = keyed.join(F.broadcast(files), F.col("name of its file") == F.col("file_name"))
            return known.select(*[F.col(f"`{c}`") for c in df.columns], (F.shiftleft("file_no", 40) + F.col("place in its file")).alias(name))
    return written(df.withColumn(name, F.monotonically_increasing_id()), compression="zstd")


HOT, HOT_KEYS = 1000, 100_000


def most_rows(total: int) -> int:
    """Rows of a key from which on it is hot: of ``total`` rows fewer than ``HOT_KEYS`` keys have more."""
    return max(HOT, total // HOT_KEYS)


def by_key(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key and in ``size`` how many ``rows`` have it.

    Facts of hot keys, which are fewer than ``HOT_KEYS``, are broadcast, so
    that rows of one key needn't meet in one task. Both should be written
    tables, as each is read more than once. ``total``: how many ``rows`` there
    are, where that is known.
    """
    hot = F.col(size) > most_rows(rows.count() if total is None else total)
    large = facts.where(hot)
    if not large.take(1):
        return rows.join(facts, keys)
    rest = rows.join(F.broadcast(large.select(keys)), keys, "left_anti").join(facts.where(~hot), keys)
    return rows.join(F.broadcast(large), keys).unionByName(rest)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def bucket(col: str, mod: int) -> Column:
    """crc32(value as text) mod ``mod``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def chunks(texts: Iterable[bytes], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts come to about ``limit`` bytes; one text is never split."""
    start = size = 0
    n = 0
    for n, t in enumerate(texts, 1):
        size += len(t)
        if size >= limit:
            yield start, n
            start, size = n, 0
    if n > start:
        yield start, n


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


SLICE_BYTES = 2 << 20


def lean(run):
    """``run`` (batches to batches) on slices of at most 1000 rows and ``SLICE_BYTES``, one row at least, with what its allocators hold unused given back after each task."""

    def slices(batches):
        for batch in batches:
            left = [batch]
            while left:
                part = left.pop()
                if part.num_rows > 1 and (part.num_rows > 1000 or part.nbytes > SLICE_BYTES):
                    half = part.num_rows // 2
                    left += (part.slice(half), part.slice(0, half))
                elif part.num_rows:
                    yield part

    def trimmed(batches):
        yield from run(slices(batches))
        give_back()

    return trimmed


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


HASHED_AT_ONCE = 1 << 20  # bytes; hashing takes some forty for each


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``raw[start:end]`` for ascending ranges, by differences of a prefix polynomial for each block."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + HASHED_AT_ONCE)))
        part = raw[low : int(ends[j - 1])]
        begin, end = starts[i:j] - low, ends[i:j] - low
        power, inverse = _powers(len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=prefix[1:], dtype=np.uint64)
        out[i:j] = mix((prefix[end] - prefix[begin]) * inverse[begin])
        i = j
    return out


def token_hashes(texts: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, and for each text the index of its first token (one more entry ends the last)."""
    raw = _FOLD[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~space[raw]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return run_hashes(raw, starts, ends), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words (of the whole text where it has fewer), text by text, repeats included, and where each text's begin."""
    count = np.diff(first)
    n = len(words)
    weight = [np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(k + 1)]
    shingle = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        shingle += words[i : n - k + 1 + i] * weight[i] if n >= k else np.uint64(0)
    each = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=begin[1:])
    out = np.zeros(begin[-1], np.uint64)
    long = np.flatnonzero(count >= k)
    if len(long):
        m = each[long]
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(begin[long], m) + step] = mix(shingle[np.repeat(first[long], m) + step])
    for d in np.flatnonzero((count > 0) & (count < k)):
        own = words[first[d] : first[d + 1]]
        total = (own * np.array(weight[: len(own)], np.uint64)).sum(dtype=np.uint64, keepdims=True)
        out[begin[d]] = mix(total + np.array([len(own)], np.uint64) * weight[k])[0]
    return out, begin
