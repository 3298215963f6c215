"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of the lines
before and after it; forward-backward gives the marginal of "good" for each
line, and a document's score is the mean of these, weighted by line length.
The field is trained with numpy on a bounded sample of labelled documents,
whose label stands for all of their lines; features of whole texts are counted
with numpy in Arrow batches. Labels, language, source and id are no features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bucket, chunks, lean, run_hashes, utf8

UPPER, LOWER, DIGIT, SPACE, STOP, BAR, MARK, OTHER, CONTROL = range(9)
KINDS = 9


def _kinds() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[:32] = out[127] = CONTROL
    out[[9, 11, 12, 13, 32]] = SPACE
    out[65:91], out[97:123], out[48:58], out[128:] = UPPER, LOWER, DIGIT, LOWER
    out[[ord(c) for c in ".,;:'\"-()"]] = STOP
    out[ord("|")] = BAR
    out[[ord(c) for c in "!?"]] = MARK
    return out


KIND = _kinds()
OWN = 13  # features of one line


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line (itself, before, after: 3 * OWN), its weight, and where each text's lines begin (one more entry)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    n = len(ends)
    line = np.repeat(np.arange(n), size + 1)
    kind = KIND[raw]
    kind[ends] = SPACE
    count = np.bincount(line * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    count[:, SPACE] -= 1
    visible = np.maximum(size - count[:, SPACE], 1)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[1:] = kind != SPACE
    edge = np.diff(inside, append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = line[first]
    words = np.bincount(of, minlength=n).astype(np.float64)
    value = run_hashes(raw, first, last)
    again = (value[1:] == value[:-1]) & (of[1:] == of[:-1])
    repeated = np.bincount(of[1:][again], minlength=n)
    whole = run_hashes(raw, starts, ends)
    same = np.append(False, (whole[1:] == whole[:-1]) & (size[1:] > 0))
    closing = kind[np.maximum(ends - 1, 0)]
    some = size > 0
    own = np.stack(
        [
            count[:, UPPER] / visible,
            count[:, LOWER] / visible,
            count[:, DIGIT] / visible,
            count[:, STOP] / visible,
            count[:, BAR] / visible,
            count[:, MARK] / visible,
            count[:, OTHER] / visible,
            count[:, CONTROL] / visible,
            repeated / np.maximum(words - 1, 1),
            np.log1p(words),
            np.minimum(visible / np.maximum(words, 1), 40) / 10,
            same,
            some & (closing == STOP),
        ],
        axis=1,
    ).astype(np.float32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([t.count(b"\n") + 1 for t in texts], out=at[1:])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[at[:-1]], after[at[1:] - 1] = 0, 0
    return np.hstack([own, before, after]), np.maximum(size, 1).astype(np.float64), at


class LineField:
    """Binary field: ``unary`` log-odds of good by line, ``pair[a, b]`` weight of label b after a."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, pair: np.ndarray):
        self.mean, self.scale, self.weight, self.pair = mean, scale, weight, pair

    def unary(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale).astype(np.float64) @ self.weight[:-1] + self.weight[-1], -30, 30)

    def marginals(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(good) of each line by forward-backward, for all texts at once."""
        return _forward_backward(self.unary(x), at, self.pair)[0]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def _forward_backward(u: np.ndarray, at: np.ndarray, pair: np.ndarray, piece: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good and the expected count of each label pair, over whole chains.

    Chains are walked in pieces, all at once and the longest first, so that
    those still running are a prefix. What reaches a piece from the pieces
    before and after it comes from their products of transfer matrices.
    """
    psi, move = np.stack([np.ones_like(u), np.exp(u)], axis=1), np.exp(pair)
    chain = np.diff(at)
    pieces = -(-chain // piece)
    of = np.repeat(np.arange(len(chain)), pieces)
    step = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = at[:-1][of] + piece * step
    length = np.minimum(at[1:][of] - first, piece)
    opens = step == 0
    entry, leave = np.ones((len(of), 2)), np.ones((len(of), 2))

    def order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[np.argsort(-length[rows], kind="stable")]
        most = int(length[rows[0]]) if len(rows) else 0
        return rows, np.searchsorted(-length[rows], -np.arange(1, most + 1), side="right")

    def onward(x: np.ndarray, t: int, rows: np.ndarray) -> np.ndarray:
        """``x`` after line ``t`` of the pieces; the first line of a chain has none before it."""
        moved = x @ move
        if t == 0:
            new = opens[rows]
            moved[new] = x[new]
        here = psi[first[rows] + t]
        return _scaled(moved * (here if x.ndim == 2 else here[:, None, :]))

    rows, running = order(np.flatnonzero(pieces[of] > 1))
    if len(rows):
        product = np.broadcast_to(np.eye(2), (len(of), 2, 2)).copy()
        for t, n in enumerate(running):
            product[rows[:n]] = onward(product[rows[:n]], t, rows[:n])
        for k in range(1, int(pieces.max())):
            here = np.flatnonzero(step == k)
            entry[here] = _scaled((entry[here - 1][:, None, :] @ product[here - 1])[:, 0])
        for k in range(int(pieces.max()) - 1, 0, -1):
            here = np.flatnonzero(step == k)
            leave[here - 1] = _scaled((product[here] @ leave[here][:, :, None])[:, :, 0])
    rows, running = order(np.arange(len(of)))
    alpha, beta = np.ones_like(psi), np.ones_like(psi)
    for t, n in enumerate(running):
        here = first[rows[:n]] + t
        alpha[here] = onward(alpha[here - 1] if t else entry[rows], t, rows[:n])
    beta[first + length - 1] = leave
    for t in range(len(running) - 2, -1, -1):
        here = first[rows[: running[t + 1]]] + t
        beta[here] = _scaled((psi[here + 1] * beta[here + 1]) @ move.T)
    inner = np.ones(len(u), bool)
    inner[at[1:] - 1] = False
    t = np.flatnonzero(inner)
    joint = alpha[t][:, :, None] * move * (psi[t + 1] * beta[t + 1])[:, None, :]
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), _scaled(joint).sum(axis=0)


class Likelihood:
    """Of the labels of all lines of the chains; ``slope`` is the mean over lines of its derivative, negated, by weights and pair weights."""

    def __init__(self, z: np.ndarray, y: np.ndarray, at: np.ndarray):
        self.z, self.y, self.at = z, y, at
        inner = np.ones(len(y), bool)
        inner[at[1:] - 1] = False
        left = np.flatnonzero(inner)
        self.seen = np.zeros((2, 2))
        np.add.at(self.seen, (y[left].astype(int), y[left + 1].astype(int)), 1)

    def slope(self, theta: np.ndarray) -> np.ndarray:
        w, pair = theta[:-4], theta[-4:].reshape(2, 2)
        p, expected = _forward_backward(np.clip((self.z @ w.astype(np.float32)).astype(np.float64), -30, 30), self.at, pair)
        return np.concatenate([self.z.T @ (p - self.y).astype(np.float32), (expected - self.seen).ravel()]) / len(self.y)


def train(texts: list[bytes], labels: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> LineField:
    """Maximises the likelihood of the line labels of whole texts with Adam."""
    if not len(texts):
        width = 3 * OWN
        return LineField(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)))
    parts = [line_features(texts[a:b]) for a, b in chunks(texts, 1 << 20)]
    x = np.concatenate([p[0] for p in parts])
    at = np.append(0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts])))
    y = np.repeat(np.asarray(labels, np.float64), np.diff(at))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    likelihood = Likelihood(np.hstack([(x - mean) / scale, np.ones((len(x), 1), np.float32)]), y, at)
    theta = np.zeros(3 * OWN + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = likelihood.slope(theta) + decay * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineField(mean, scale, theta[:-4].copy(), theta[-4:].reshape(2, 2).copy())


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineField:
    """Fits on at most ``sample`` labelled rows (those of least hash of the id), as many of these as have ``sample_bytes`` of text together.

    Null labels and texts of no row are left out; of rows that repeat an id
    one text counts; an id with both labels is good.
    """
    key = F.col(id_col)
    order = F.struct(F.xxhash64(key), key)
    chosen = labels.where(F.col(label_col).isNotNull() & key.isNotNull()).groupBy(key).agg(F.max(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(order).limit(sample)
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    sizes = docs.select(key, size.alias("size")).join(F.broadcast(chosen), id_col).groupBy(key).agg(F.max("size").alias("size"), F.max("y").alias("y"))
    # a window over at most ``sample`` rows
    chosen = sizes.withColumn("all", F.sum("size").over(Window.orderBy(order))).where(F.col("all") <= sample_bytes).select(key, "y")
    rows = docs.select(key, F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("t")).join(F.broadcast(chosen), id_col).groupBy(key).agg(F.max("t").alias("t"), F.max("y").alias("y")).toArrow()
    rows = rows.sort_by(id_col)
    return train([bytes(t) for t in rows.column("t").to_pylist()], rows.column("y").to_numpy())


def score_lines(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: ``<id_col>, line, n_bytes, good`` (the marginal)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x, weight, at in _features(batches):
            n = np.diff(at)
            number = np.arange(at[-1]) - np.repeat(at[:-1], n)
            where = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([keys.take(where), pa.array(number), pa.array(weight.astype(np.int64)), pa.array(model.marginals(x, at))], ["id", "line", "n_bytes", "good"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(score), "id long, line long, n_bytes long, good double").withColumnRenamed("id", id_col)


def _features(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        texts, keys = utf8(batch.column(1)), batch.column(0)
        for a, b in chunks(texts):
            yield keys.slice(a, b - a), *line_features(texts[a:b])


def score_documents(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, score`` of every row's whole text.

    Null and empty texts are one empty line. Repeated rows stay repeated,
    extra columns are ignored, an empty table gives an empty one.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x, weight, at in _features(batches):
            total = np.add.reduceat(model.marginals(x, at) * weight, at[:-1]) / np.add.reduceat(weight, at[:-1])
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.clip(total, 0.0, 1.0))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(score), "id long, score double").withColumnRenamed("id", id_col)


def with_score(docs: DataFrame, model: LineField, name: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score as ``name``, in one pass without a join; each row is judged by its own text."""
    place = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, x, weight, at in _features([pa.RecordBatch.from_arrays([batch.column(place), batch.column(place)], ["key", "text"])]):
                parts.append(np.add.reduceat(model.marginals(x, at) * weight, at[:-1]) / np.add.reduceat(weight, at[:-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(np.concatenate(parts), 0.0, 1.0))], [*batch.schema.names, name])

    return docs.mapInArrow(lean(score), StructType([*docs.schema, StructField(name, DoubleType())]))


THRESHOLD = 0.7


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, predicted`` of all ``docs``, learnt from labels of rows outside the held-out quarter."""
    model = fit(docs, labels.where(bucket("doc_id", 4) != 2))
    return score_documents(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judged(docs, labels).select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
