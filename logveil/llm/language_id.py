"""Language of whole texts by a convolutional network over bytes.

Bytes (``A-Z`` lower-cased) are embedded, filters of widths 2, 3 and 4 run
over fixed-length windows, each filter keeps its maximum in the window, and a
softmax layer gives the languages. It is trained in numpy on a bounded sample.
For prediction a filter is a sum of table rows, one for each byte pair, so a
window takes look-ups and a maximum; windows cover the whole text, and their
probabilities are averaged, weighted by letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _FOLD, bucket, chunks, lean, utf8

WINDOW = 192
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC2:0xF5] = True


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of folded bytes (the last of a text padded with 0), each one's letters, and where each text's begin; an empty text has one."""
    count = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    raw = np.frombuffer(b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, count.tolist(), strict=True)), np.uint8).reshape(-1, WINDOW)
    return _FOLD[raw], _LETTER[raw].sum(axis=1), at


class ByteNet:
    def __init__(self, languages: list[str], depth: int = 12, filters: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, depth)).astype(np.float32)
        self.filter = [rng.normal(0, (2 / (w * depth)) ** 0.5, (w, depth, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(filters, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self._pairs: list | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filter, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy. The gradient passes only through the place of each filter's maximum."""
        e = self.embed[x]
        n = len(x)
        pooled, places = [], []
        for f, b in zip(self.filter, self.bias, strict=True):
            w = len(f)
            c = sum(e[:, j : WINDOW - w + 1 + j] @ f[j] for j in range(w))
            best = c.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(c, best[:, None], 1)[:, 0] + b, 0))
            places.append(best)
        h = np.hstack(pooled)
        s = h @ self.out + self.out_bias
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        d_out, d_out_bias = h.T @ p, p.sum(axis=0)
        d_h = (p @ self.out.T) * (h > 0)
        d_embed, d_filter, d_bias = np.zeros_like(self.embed), [], []
        width = self.bias[0].size
        for k, (f, best) in enumerate(zip(self.filter, places, strict=True)):
            d = d_h[:, k * width : (k + 1) * width]
            g = np.zeros_like(f)
            for j in range(len(f)):
                byte = np.take_along_axis(x, best + j, 1)
                g[j] = np.einsum("nfd,nf->df", self.embed[byte], d)
                np.add.at(d_embed, byte.ravel(), (d[:, :, None] * f[j].T[None]).reshape(-1, f.shape[1]))
            d_filter.append(g)
            d_bias.append(d.sum(axis=0))
        return [d_embed, *d_filter, *d_bias, d_out, d_out_bias]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        parameters = self.parameters()
        m, v = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                pick = order[i : i + batch]
                for k, g in enumerate(self.gradients(x[pick], y[pick])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    parameters[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self._pairs = None

    def _tables(self) -> list:
        """For each width the filters' sums for a first pair of bytes, and for the bytes after it."""
        if self._pairs is None:
            self._pairs = []
            for f in self.filter:
                each = [self.embed @ part for part in f]
                tables = [(each[0][:, None] + each[1][None]).reshape(65536, -1)]
                if len(f) == 3:
                    tables.append(each[2])
                elif len(f) == 4:
                    tables.append((each[2][:, None] + each[3][None]).reshape(65536, -1))
                self._pairs.append(tables)
        return self._pairs

    def probabilities(self, x: np.ndarray, step: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), step):
            part = x[i : i + step]
            pair = part[:, :-1].astype(np.intp) * 256 + part[:, 1:]
            pooled = []
            for tables, f, b in zip(self._tables(), self.filter, self.bias, strict=True):
                w = len(f)
                n = WINDOW - w + 1
                c = tables[0].take(pair[:, :n].T, axis=0)
                if w == 3:
                    c += tables[1].take(part[:, 2:].T, axis=0)
                elif w == 4:
                    c += tables[1].take(pair[:, 2:].T, axis=0)
                pooled.append(np.maximum(c.max(axis=0) + b, 0))
            s = np.hstack(pooled) @ self.out + self.out_bias
            p = np.exp(s - s.max(axis=1, keepdims=True))
            out[i : i + step] = p / p.sum(axis=1, keepdims=True)
        return out

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        x, letters, at = windows(texts)
        weighted = self.probabilities(x) * letters[:, None]
        total = np.add.reduceat(letters, at[:-1])
        mean = np.add.reduceat(weighted, at[:-1], axis=0) / np.maximum(total, 1)[:, None]
        best = mean.argmax(axis=1)
        score = mean[np.arange(len(best)), best].astype(np.float64)
        names = [self.languages[b] for b in best.tolist()]
        plain = np.array([not t.isascii() for t in texts])
        for i in np.flatnonzero((total == 0) | plain):
            if total[i] == 0 or not any(map(str.isalpha, texts[i].decode("utf-8", "replace"))):
                names[i], score[i] = UNKNOWN, 0.0
        return names, np.clip(score, 0.0, 1.0)


def spread(texts: list[bytes], per_text: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``per_text`` windows with letters of each text, spread over it, and the text of each."""
    x, letters, at = windows(texts)
    pick = np.unique(np.concatenate([np.linspace(a, b - 1, per_text).astype(int) for a, b in zip(at[:-1], at[1:], strict=True)]))
    pick = pick[letters[pick] > 0]
    return x[pick], np.searchsorted(at, pick, side="right") - 1


def fit(docs: DataFrame, sample: int = 3000, per_text: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteNet | None:
    """Trains on at most ``sample`` labelled texts (least hash of the id), ``per_text`` windows of each, spread over it. None without labels.

    Windows are cut by the executors, so the driver gets at most
    ``sample * per_text * WINDOW`` bytes, however long the texts are. Of rows
    that repeat an id the greatest text counts.
    """
    rows = docs.where(F.col(label_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("y"))
    # the sample is chosen without the texts, which then join it
    chosen = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max(F.struct("text", "y")).alias("s")).select("id", "s.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, owner = spread(utf8(batch.column(1)), per_text)
            where = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(2).take(where), pa.array([w.tobytes() for w in x], pa.binary())], ["id", "y", "window"])

    found = texts.select(F.col("id").cast("string"), "text", "y").mapInArrow(lean(cut), "id string, y string, window binary").toArrow().sort_by([("id", "ascending"), ("window", "ascending")])
    if not found.num_rows:
        return None
    labels = found.column("y").to_pylist()
    languages = sorted(set(labels))
    x = np.frombuffer(b"".join(found.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    net = ByteNet(languages)
    net.train(x, np.array([languages.index(v) for v in labels]), epochs=max(4, min(40, 40_000 // len(x))))
    return net


def predict_languages(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, lang_pred, score`` of every row.

    Null, empty and letterless texts are ``und`` with score 0, as is every
    text without a model. Of languages of equal probability the first by name
    is taken. Repeated rows stay repeated, extra columns are
    ignored, an empty table gives an empty one.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = utf8(batch.column(1)), batch.column(0)
            for a, b in chunks(texts, 2 << 20):
                names, score = net.predict(texts[a:b]) if net else ([UNKNOWN] * (b - a), np.zeros(b - a))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(predict), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    net = fit(docs.where(bucket("doc_id", 3) != 1))
    return predict_languages(docs, net).select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
