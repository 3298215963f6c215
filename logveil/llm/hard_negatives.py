"""Hard negatives by Fagin's threshold algorithm.

Components become integers (256 times, rounded down); a row's score is its
integer inner product with the anchor. Rows are dealt into blocks by ranges of
(label, row), so that a hot label is many blocks, and each block is written
once with its candidate list of every dimension, sorted by component. An anchor
reads the lists of a block from the end that its own sign of the dimension makes best (sorted
access), scores what it meets there for the first time (random access), and
stops once the threshold, the score of a row that had the component last read
in every dimension, lies strictly below the score that the window's last place
has so far, or below the window, or when no row is left. Blocks that a task
reads one after the other share these places.

Positives come first: the best rows of the anchor's label. Each positive opens
a window of scores, and one more pass over the blocks fills all windows of an
anchor at once from rows of other labels. Anchors are sent in rounds of at most
``SENT`` bytes; a task gives for each anchor only what its own places hold, and
windows over these make the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, shared_dir, written

BLOCK = 8192  # rows of a block at most
FEWEST = 512  # rows of a block at least, where there are fewer blocks than twice the cores
SENT = 4 << 20  # bytes of anchors sent to the executors at once
STEP = 64  # places that the first sorted access reads of each list; each further one reads as many as all before
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # of a long
EXACT32, EXACT64 = 1 << 24, 1 << 53  # sums below are exact in floating point
BLOCKS = "ids binary, labels binary, rows binary, vectors binary, lists binary, n int, dims int"
FOUND = "anchor long, row long, id long, score long"


def integers(vector: Column) -> Column:
    """``floor(256 * x)`` of each component as double; beyond a long its bounds."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def usable(id_: Column, label: Column, vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return id_.isNotNull() & label.isNotNull() & vector.isNotNull() & whole


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """A row of longs for each list; shorter ones end in noughts."""
    at = np.asarray(lists.offsets, np.int64)
    flat, size = np.asarray(lists.values, np.int64)[at[0] : at[-1]], np.diff(at)
    out = np.zeros((len(size), max(size, default=0)), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _packed(vectors: np.ndarray) -> np.ndarray:
    """In the smallest type that holds all."""
    low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return vectors.astype(kind)
    return vectors


def _places_in(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def blocks(rows: DataFrame, block: int | None = None) -> DataFrame:
    """Written blocks of ``rows (row, id, label, vector)``: ids, labels, components, and the sorted list of each dimension as places."""
    most = block or BLOCK
    total = rows.count()
    cores = 2 * rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-total // most), min(cores, -(-total // FEWEST)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            x = _matrix(table.column("vector").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64())))
            ids = table.column("id").to_numpy()
            by_id = np.argsort(ids, kind="stable")  # components that tie stand by id
            lists = by_id[np.argsort(x[by_id], axis=0, kind="stable")].T.astype(_places_in(len(ids)))
            packed = _packed(x)
            each = [ids.tobytes(), table.column("label").to_numpy().tobytes(), table.column("row").to_numpy().tobytes(), packed.tobytes(), lists.tobytes()]
            return pa.RecordBatch.from_arrays([*(pa.array([b], pa.binary()) for b in each), pa.array([len(ids)], pa.int32()), pa.array([x.shape[1]], pa.int32())], ["ids", "labels", "rows", "vectors", "lists", "n", "dims"])

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == most:
                    yield made(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield made(pa.Table.from_batches(held))
        give_back()

    dealt = rows.repartitionByRange(parts, "label", "row").sortWithinPartitions("label", "row")
    return written(dealt.select("row", "id", "label", "vector").mapInArrow(build, BLOCKS))


class Block:
    """A block with its lists in both directions."""

    def __init__(self, ids: bytes, labels: bytes, rows: bytes, vectors: bytes, lists: bytes, n: int, dims: int):
        self.ids, self.labels, self.rows = (np.frombuffer(x, np.int64) for x in (ids, labels, rows))
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(vectors) // (n * dims)] if n * dims else np.int64
        self.x = np.frombuffer(vectors, kind).reshape(n, dims).astype(np.int64)
        self.n, self.dims = n, dims
        up = np.frombuffer(lists, _places_in(n)).reshape(dims, n).astype(np.int32)
        self.lists = np.concatenate([up, up[:, ::-1]])  # ascending, then descending
        self.top = np.abs(self.x.astype(np.float64)).max(axis=0, initial=0.0)
        self.as_: dict[type, np.ndarray] = {np.int64: self.x}

    def scorer(self, q: np.ndarray):
        """Exact inner products with ``q`` by place, the fastest way that its size allows; beyond a long its bounds."""
        bound = float((np.abs(q.astype(np.float64)) * self.top).sum())
        kind = np.float32 if bound < EXACT32 else np.float64 if bound < EXACT64 else np.int64
        if bound >= 2.0**62:
            wide = [int(v) for v in q]
            return lambda at: np.array([min(max(sum(a * b for a, b in zip(wide, row, strict=True)), LEAST), MOST) for row in self.x[at].tolist()], np.int64)
        if kind not in self.as_:
            self.as_[kind] = self.x.astype(kind)
        x, v = self.as_[kind], q.astype(kind)
        return lambda at: (x[at] @ v).astype(np.int64)


class Places:
    """The best ``k`` (score, id, row) of a window of scores; the least of them is the bar."""

    __slots__ = ("low", "high", "k", "heap", "bar")

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.heap: list[tuple[int, int, int]] = []
        self.bar = low  # a row must have as much at least

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        here = np.flatnonzero((scores >= self.bar) & (scores <= self.high))
        if len(here) > self.k:
            edge = np.partition(scores[here], len(here) - self.k)[len(here) - self.k]
            here = here[scores[here] >= edge]
        for s, i, r in zip(scores[here].tolist(), ids[here].tolist(), rows[here].tolist(), strict=True):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (s, -i, -r))
            elif (s, -i, -r) > self.heap[0]:
                heapq.heapreplace(self.heap, (s, -i, -r))
        if len(self.heap) == self.k and self.k:
            self.bar = max(self.low, self.heap[0][0])


def searched(block: Block, q: np.ndarray, allowed: np.ndarray, windows: list[Places]) -> int:
    """Fills ``windows`` from the block's rows that are ``allowed``; returns how many rows were met."""
    q = np.append(q, np.zeros(max(0, block.dims - len(q)), np.int64))[: block.dims]
    score = block.scorer(q)

    def take(at: np.ndarray) -> None:
        at = at[allowed[at]]
        if len(at):
            scores, ids, rows = score(at), block.ids[at], block.rows[at]
            for w in windows:
                w.add(scores, ids, rows)

    dims = np.flatnonzero(q)
    if not len(dims):  # every score is nought
        take(np.arange(block.n))
        return block.n
    lists = np.where(q[dims] > 0, block.dims + dims, dims)
    met = np.zeros(block.n, bool)
    weights = [int(v) for v in q[dims]]
    depth, done = 0, 0
    while done < block.n:
        upto = min(block.n, max(STEP, 2 * depth))
        before = met.copy()
        met[block.lists[lists, depth:upto].ravel()] = True
        take(np.flatnonzero(met & ~before))
        done, depth = int(met.sum()), upto
        edge = block.x[block.lists[lists, depth - 1], dims].tolist()
        threshold = sum(a * b for a, b in zip(weights, edge, strict=True))
        if all(threshold < w.bar for w in windows):
            break
    return done


def _rounds(anchors: DataFrame) -> list[DataFrame]:
    """The written anchors in parts of at most ``SENT`` bytes each, however many they are."""
    size = anchors.agg(F.sum(F.size("vector") * 8 + 200), F.max(F.size("vector") * 8 + 200)).first()
    if not size[0]:
        return []
    parts = max(1, -(-size[0] // SENT))
    while True:
        by = F.pmod(F.xxhash64("row"), F.lit(parts))
        most = anchors.groupBy(by).agg(F.sum(F.size("vector") * 8 + 200).alias("bytes")).agg(F.max("bytes")).first()[0]
        if most <= max(SENT, 2 * size[1]) or parts >= 4 * -(-size[0] // SENT) + 64:
            return [anchors.where(by == k) for k in range(parts)]
        parts *= 2


def _over(index: DataFrame, anchors: DataFrame, own: bool, places) -> DataFrame:
    """``anchor, row, id, score`` of what the places of each task hold; ``places(bounds)`` gives an anchor's, ``own`` its own label or the others."""
    spark, path = index.sparkSession, shared_dir(index.sparkSession)
    spark.createDataFrame([], FOUND).write.parquet(path)
    for part in _rounds(anchors):
        got = part.toArrow()  # at most SENT bytes
        if not got.num_rows:
            continue
        sent = spark.sparkContext.broadcast([c.to_pylist() for c in (got.column("row"), got.column("label"), got.column("bounds"))] + [[np.array(v, np.int64) for v in got.column("vector").to_pylist()]])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            rows, labels, bounds, vectors = sent.value
            held = [places(b) for b in bounds]
            for batch in batches:
                for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    block = Block(*values)
                    here = {label: block.labels == label for label in set(labels)}
                    for row, label, vector, windows in zip(rows, labels, vectors, held, strict=True):
                        allowed = here[label] if own else ~here[label]
                        if windows and allowed.any():
                            if own:
                                allowed = allowed & (block.rows != row)
                            searched(block, vector, allowed, windows)
            out = [(row, -r, -i, s) for row, windows in zip(rows, held, strict=True) for s, i, r in {x for w in windows for x in w.heap}]
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out[k : k + 10_000]], pa.int64()) for j in range(4)], ["anchor", "row", "id", "score"])
            give_back()

        index.mapInArrow(run, FOUND).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(FOUND).parquet(path)


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest score ``n`` with ``low * p <= 100 * n <= high * p``; empty where the first is the greater."""
    return max(LEAST, -(-low * positive // 100)), min(MOST, high * positive // 100)


def mined(vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, block: int | None = None, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor and positive.

    Anchors are rows whose id is divisible by ``every``; an anchor's positives
    are its best ``positives`` other rows of the same label, and for each the
    best ``negatives`` rows of other labels stay that have from ``low`` to
    ``high`` hundredths of the positive's score. Higher scores come first, ties
    by smaller id. Rows with a null id, label or vector, or with a null or
    non-finite component, take no part. Of vectors of unequal length the
    shorter ends in noughts; an empty one scores nought with all. Components
    and scores beyond a long become its bounds. Rows that repeat an id are
    each a row: they are anchors, positives and negatives of their own, but no
    row is a positive of itself. A window that no score fits (a positive's
    score below nought) gives nothing, an anchor without positives neither.
    Extra columns are ignored; an empty table gives an empty result.
    """
    id_, label, vector = F.col(id_col), F.col(label_col), F.col(vector_col)
    # row numbers must stay the same when a lost part is made again, so they are written
    rows = written(vectors.where(usable(id_, label, vector)).select(F.monotonically_increasing_id().alias("row"), id_.cast("long").alias("id"), label.cast("long").alias("label"), integers(vector).alias("vector")))
    index = blocks(rows, block)
    anchors = written(rows.where(F.col("id") % every == 0))
    unbound = anchors.withColumn("bounds", F.array().cast("array<bigint>"))
    near = _over(index, unbound, True, lambda _: [Places(LEAST, MOST, positives)])
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    chosen = written(near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives))
    bounds = chosen.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_set("score")).alias("bounds"))  # so many as positives
    bound = written(anchors.join(bounds, "row"))
    far = _over(index, bound, False, lambda scores: [Places(a, b, negatives) for a, b in (window(s, low, high) for s in scores) if a <= b])
    met = chosen.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(far.select("anchor", "row", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "anchor")
    wide = [F.col(c).cast("decimal(20,0)") for c in ("positive_score", "negative_score")]
    met = met.where((wide[0] * low <= wide[1] * 100) & (wide[1] * 100 <= wide[0] * high))
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "row")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = ranked.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors.withColumn("label", moved))


OP11_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           [floor(256 * cast(x as double)) for x in embedding] as q
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
    select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.q, r.q) as bigint) as score
    from v a, v r where a.vec_id % 100 = 0 and a.vec_id <> r.vec_id
), p as (
    select anchor_id, vec_id as positive_id, score as positive_score
    from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 10
"""
