"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits and of all other UTF-8 bytes,
``A-Z`` lower-cased. A seed is the hash of ``least`` words of a benchmark item
(of all its words where it has fewer). A text that holds ``coverage`` of an
item's words in tiles of ``least`` words shares at least
``coverage * words / least`` of its seeds, so it has one of any set of seeds
that leaves out fewer; kept are the seeds that the fewest items have. A bitmap
of fixed size tells at the scan which texts can have one, and an exact join of
their seeds with the kept ones gives the pairs of text and item to tile.

Tiling repeats: by binary search over the length, with Karp-Rabin hashes of
all windows that hold no marked word, the longest common run is found, its
words are compared, and it is marked on both sides; until none of ``least``
words is left. The marked share of an item's words is its coverage, whatever
the order of the passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _BASE, _powers, by_key, chunks, give_back, lean, mix, shingle_hashes, token_hashes, utf8, written

LEAST, COVERAGE = 5, 0.5
BITS = 27  # of the bitmap of seeds, whatever the benchmark's size
GROUP_BYTES = 4 << 20  # of texts tiled in one group
SENT = 500_000  # seeds that may be broadcast
BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False


def _prefix(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(len(words) + 1)[0][: len(words)], out=out[1:], dtype=np.uint64)
    return out


def _windows(prefix: np.ndarray, marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``size`` words without a marked one begin, and their hashes."""
    n = len(prefix) - size
    free = np.append(0, np.cumsum(marks))
    at = np.flatnonzero(free[size:] == free[:n])
    return at, (prefix[at + size] - prefix[at]) * _powers(len(prefix))[1][at]


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles ``(place in text, place in item, words)`` of two rows of word numbers (hashes).

    The longest first; of equal ones the earliest in the text, then in the item.
    """
    sides = [(_prefix(w), np.zeros(len(w), bool)) for w in (text, item)]
    tiles: list[tuple[int, int, int]] = []

    def first(size: int) -> tuple[int, int] | None:
        (a, x), (b, y) = (_windows(p, m, size) for p, m in sides)
        for i in np.flatnonzero(np.isin(x, y)).tolist():
            for j in np.flatnonzero(y == x[i]).tolist():
                if np.array_equal(text[a[i] : a[i] + size], item[b[j] : b[j] + size]):
                    return int(a[i]), int(b[j])
        return None

    most = min(len(text), len(item))
    while most >= least:
        low, high, found = least - 1, most, None  # a run of low words is there, none of more than high
        size = most
        while low < high:
            place = first(size)
            if place:
                low, found = size, place
            else:
                high = size - 1
            size = (low + high + 1) // 2
        if not found:
            break
        a, b = found
        tiles.append((a, b, low))
        sides[0][1][a : a + low] = sides[1][1][b : b + low] = True
        most = low
    return tiles


def _numbered(texts: list[bytes]) -> list[np.ndarray]:
    """The words of each text as numbers, equal only for equal words."""
    kinds: dict[bytes, int] = {}
    fold = bytes(32 if BETWEEN[k] else k + 32 if 65 <= k < 91 else k for k in range(256))
    return [mix(np.array([kinds.setdefault(w, len(kinds) + 1) for w in t.translate(fold).split()], np.uint64)) for t in texts]


def item_seeds(items: DataFrame, coverage: float, least: int) -> DataFrame:
    """``seed, item`` of ``items (item, text)``: the seeds kept of each item."""
    names = ["item", "words", "place", "seed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = utf8(batch.column(1)), batch.column(0)
            for a, b in chunks(texts):
                words, first = token_hashes(texts[a:b], BETWEEN)
                count = np.diff(first)
                for size in range(1, least + 1):
                    seeds, at = shingle_hashes(words, first, size)
                    owner = np.repeat(np.arange(b - a), np.diff(at))
                    place = np.arange(len(seeds)) - at[owner]
                    own = (count[owner] >= least) if size == least else (count[owner] == size)
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).take(pa.array(owner[own])), pa.array(count[owner[own]]), pa.array(place[own]), pa.array(seeds[own].view(np.int64))], names)

    all_ = written(items.select("item", "text").mapInArrow(lean(run), "item long, words long, place long, seed long"))
    often = written(all_.groupBy("seed").agg(F.count_distinct("item").alias("items"), F.count(F.lit(1)).alias("rows")))
    ranked = by_key(all_, often, ["seed"], "rows").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("items", "seed", "place")))
    seeds = F.greatest(F.col("words") - (least - 1), F.lit(1))
    shared = F.greatest(F.ceil(F.col("words") * coverage / least), F.lit(1))
    return written(ranked.where(F.col("rank") <= F.greatest(seeds - shared + 1, F.lit(1))).select("seed", "item", F.when(F.col("words") < least, F.col("words")).otherwise(least).cast("int").alias("size")).distinct())


def seed_map(seeds: DataFrame) -> np.ndarray:
    """Bitmap of ``2 ** BITS`` bits with two set for every seed; at most ``2 ** (BITS - 3)`` bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.concatenate(_cells(batch.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(cell >> 3), pa.array((1 << (cell & 7)).astype(np.int32))], ["byte", "bit"])

    got = seeds.select("seed").mapInArrow(run, "byte long, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    out[got.column("byte").to_numpy()] = got.column("bits").to_numpy()
    return out


def _cells(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - BITS)
    return (seeds >> shift).astype(np.int64), (mix(seeds ^ _BASE) >> shift).astype(np.int64)


def possible(docs: DataFrame, bitmap, sizes: list[int], key: bool) -> DataFrame:
    """``row, id, text, seeds`` of ``docs (row, id, text)``: text and seeds only where some of its runs of ``sizes`` words pass the bitmap. Without ``key`` rows are numbered here."""
    schema = "row long, id long, text string, seeds array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        bits = bitmap.value
        for batch in batches:
            column = batch.column(2)
            texts = utf8(column)
            for a, b in chunks(texts):
                words, first = token_hashes(texts[a:b], BETWEEN)
                owners, found = [], []
                for size in sizes:
                    grams, at = shingle_hashes(words, first, size)
                    cells = _cells(grams)
                    hit = np.flatnonzero(np.logical_and(*((bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1 for c in cells)))
                    owner = np.searchsorted(at, hit, side="right") - 1
                    whole = np.diff(first)[owner] >= size  # a text of fewer words has no run of so many
                    owners.append(owner[whole])
                    found.append(grams[hit][whole])
                owner, seed = np.concatenate(owners), np.concatenate(found).view(np.int64)
                pairs = np.unique(np.stack([owner, seed], axis=1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
                cut = np.searchsorted(pairs[:, 0], np.arange(b - a + 1))
                none = np.diff(cut) == 0
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(pairs[:, 1]))
                rows = batch.column(0).slice(a, b - a) if key else pa.array(np.arange(row, row + b - a))
                row += b - a
                kept = column.take(pa.array(np.arange(a, b), mask=none)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([rows, batch.column(1).slice(a, b - a), kept, lists], ["row", "id", "text", "seeds"])

    return docs.select("row", "id", "text").mapInArrow(lean(run), schema)


TILES = "array<struct<text_word:int,item_word:int,words:int>>"


def _tiled(docs: DataFrame, benchmark: DataFrame, coverage: float, least: int, id_col: str, text_col: str, item_col: str, item_text: str, key_col: str | None) -> tuple[DataFrame, DataFrame]:
    """All rows ``(row, id)``, and ``row, id, item_id, coverage, tiles`` of the pairs with enough of an item."""
    if coverage <= 0:
        raise ValueError("coverage must be above nought")
    spark = docs.sparkSession
    items = written(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("item_text")))
    seeds = item_seeds(items.select("item", F.col("item_text").alias("text")), coverage, least)
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # least numbers at most
    row = F.col(key_col).cast("long") if key_col else F.lit(None).cast("long")
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    looked = written(possible(rows, spark.sparkContext.broadcast(seed_map(seeds)), sizes or [least], key_col is not None), compression="zstd")
    met = looked.where("text is not null").select("row", F.explode("seeds").alias("seed"))
    # rows of two numbers on both sides: few are sent, many are joined by sorting, where Spark splits a seed that many rows have
    known = seeds.select("seed", "item")
    pairs = written(met.join(F.broadcast(known) if known.count() <= SENT else known, "seed").select("row", "item").distinct())
    size = looked.where("text is not null").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")
    kind = pa.list_(pa.struct([("text_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        place = {r: i for i, r in enumerate(left.column("row").to_pylist())}
        texts = left.column("text").combine_chunks() if left.num_rows else pa.array([], pa.string())
        wanted: dict[int, list[int]] = {}
        item_texts, of_item = right.column("item_text").combine_chunks(), {}
        for j, (r, item) in enumerate(zip(right.column("row").to_pylist(), right.column("item").to_pylist(), strict=True)):
            if r is None:
                of_item[item] = j
            else:
                wanted.setdefault(r, []).append(item)
        out = []
        for r, own in wanted.items():
            js = [of_item[item] for item in own]
            raw = utf8(pa.concat_arrays([texts.slice(place[r], 1), item_texts.take(pa.array(js))]))
            words, *others = _numbered(raw)
            for j, item in zip(js, others, strict=True):
                tiles = tile(words, item, min(least, len(item)))
                share = sum(t[2] for t in tiles) / len(item)
                if share >= coverage:
                    out.append((r, left.column("id")[place[r]].as_py(), right.column("item_id")[j].as_py(), share, [dict(zip(("text_word", "item_word", "words"), t, strict=True)) for t in tiles]))
        give_back()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), kind)
        return pa.Table.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["row", "id", "item_id", "coverage", "tiles"])

    texts = looked.where("text is not null").select(group, "row", "id", "text").groupBy("group")
    # a group gets its pairs, and once each item of them (without a row)
    needed = pairs.select(group, "row", "item")
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("item_id", "long"), ("item_text", "string"))]
    sent = needed.select("group", "item").distinct().join(items, "item").select("group", F.lit(None).cast("long").alias("row"), "item", "item_id", "item_text")
    side = needed.select("group", "row", "item", *nothing).unionByName(sent).toDF("in_group", "row", "item", "item_id", "item_text")
    tiled = texts.cogroup(side.groupBy("in_group")).applyInArrow(run, f"row long, id long, item_id long, coverage double, tiles {TILES}")
    return looked.select("row", "id"), tiled


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``<id_col>, item_id, coverage, tiles`` for each row and item of which it has at least ``coverage``.

    ``tiles``: structs ``text_word, item_word, words``. An item of fewer than
    ``least`` words matches where all of them stand together. Empty and null
    items and texts match nothing; repeated rows and items give repeated
    results; rows and items without an id match like others; extra columns are
    ignored.
    """
    return _tiled(docs, benchmark, coverage, least, id_col, text_col, item_col, item_text, None)[1].drop("row").withColumnRenamed("id", id_col)


def verdicts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", key_col: str | None = None) -> DataFrame:
    """Every row with ``<id_col>, contaminated, item_id, coverage, n_tiles`` of the item it has most of; ties go to the least item.

    Each row is judged by its own text, also where ids repeat or are null.
    ``key_col``: a number that no two rows share, which the result then has.
    """
    rows, tiled = _tiled(docs, benchmark, coverage, least, id_col, text_col, item_col, item_text, key_col)
    best = F.max_by(F.struct("item_id", "coverage", F.size("tiles").alias("n_tiles")), F.struct("coverage", -F.col("item_id")))
    found = written(tiled.groupBy("row").agg(best.alias("b")))
    out = rows.join(found, "row", "left")
    columns = [F.col("id").alias(id_col), F.col("b").isNotNull().alias("contaminated"), F.col("b.item_id").alias("item_id"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("b.n_tiles", F.lit(0)).alias("n_tiles")]
    return out.select(*columns, *([F.col("row").alias(key_col)] if key_col else []))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the verdict and, where contaminated, the item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return verdicts(docs, benchmark)
