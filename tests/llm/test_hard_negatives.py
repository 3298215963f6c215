import math
import random

import numpy as np
import pytest
from conftest import plain
from pyspark.sql import functions as F

from logveil.llm import hard_negatives as hn
from logveil.llm import queries

KINDS = "vec_id long, label int, embedding array<float>"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, positives=5, negatives=10, every=100):
    """Every anchor against every row, by Python's own integers."""
    used = [(k, i, label, [math.floor(256 * x) for x in map(float, v)]) for k, (i, label, v) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, label, q in used:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, n) for n, j, other, v in used if other == label and n != k)[:positives]
        for p, j, _ in scored:
            far = sorted((-s, m) for m, s in ((m, sum(a * b for a, b in zip(q, v))) for _, m, other, v in used if other != label) if 30 * -p <= 100 * s <= 90 * -p)
            out += [(i, j, r, m, -p, -s) for r, (s, m) in enumerate(far[:negatives], 1)]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select(*RESULT).collect())


def made(n, dims, labels, seed=0, copies=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice(labels), [rng.gauss(0.05, 0.2) for _ in range(dims)]) for i in range(n)]
    rows = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    return rows + [(n + k, rng.choice(labels), rows[7][2]) for k in range(copies)]


def test_sql_on_the_tables(spark, duck, small):
    assert plain(queries.QUERIES["op11_hard_negatives"](spark, small).toPandas()) == plain(duck.sql(queries.ORACLE_SQL["op11_hard_negatives"]).df())


@pytest.mark.parametrize("block", [None, 7])
def test_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(hn, "FEWEST", 40)
    monkeypatch.setattr(hn, "STEP", 4)
    rows = made(400, 6, [1, 1, 1, 2, 3], copies=60)  # a hot label and many equal vectors, so many ties
    assert got(hn.mined(spark.createDataFrame(rows, KINDS), every=25, block=block)) == brute(rows, every=25)


def test_rounds_of_anchors(spark, monkeypatch):
    rows = made(300, 4, [1, 2])
    monkeypatch.setattr(hn, "SENT", 1500)
    assert got(hn.mined(spark.createDataFrame(rows, KINDS), every=10)) == brute(rows, every=10)


def test_search_ends_early_where_the_threshold_allows(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 9, (5000, 3))
    x[17] = [250, 250, -250]
    x[4000] = [240, 250, -250]
    lists = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16)
    long = np.arange(5000, dtype=np.int64)
    block = hn.Block(long.tobytes(), long.tobytes(), long.tobytes(), x.astype(np.int16).tobytes(), lists.tobytes(), 5000, 3)
    best = hn.Places(hn.LEAST, hn.MOST, 2)
    met = hn.searched(block, np.array([1, 2, -3]), np.ones(5000, bool), [best])
    assert [-i for _, i, _ in sorted(best.heap, reverse=True)] == [17, 4000] and met < 300


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (100, 1, [0.0, 0.0]), (200, 2, []), (300, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (1, 1, None), (2, 2, [1.0, None]),
        (3, 2, [nan, 1.0]), (4, 2, [inf, 1.0]), (5, 1, [0.9, 0.5]), (6, 2, [0.5]), (7, 2, [0.5, 0.25, 3.0]), (8, 2, [0.5, 0.25]), (9, 3, [0.5, 0.25]), (-100, 3, [-1.0, 1.0]),
    ]
    frame = spark.createDataFrame(rows, KINDS)
    for clash in ("row", "id", "anchor", "score", "rank", "bounds", "vector", "place"):
        frame = frame.withColumn(clash, F.lit("clash"))
    assert got(hn.mined(frame)) == brute(rows)
    assert hn.mined(frame.limit(0)).collect() == []


def test_large_components_are_exact(spark):
    rows = [(0, 1, [1e5, -3e6]), (1, 1, [2e5, 1.0]), (2, 2, [1e5, 1.0]), (3, 2, [1.2e5, 1.0]), (4, 2, [1.2e5, 1.001]), (5, 1, [3.0, -2e6])]
    rows = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert got(hn.mined(spark.createDataFrame(rows, KINDS))) == brute(rows)


def test_components_beyond_a_long_become_its_bounds(spark):
    rows = [(0, 1, [1e30]), (1, 1, [1e30]), (2, 2, [1e30]), (3, 2, [0.001]), (4, 2, [-1e30])]
    found = hn.mined(spark.createDataFrame(rows, KINDS), low=0, high=100).orderBy("rank").collect()
    assert [(r.negative_id, r.positive_score, r.negative_score) for r in found] == [(2, hn.MOST, hn.MOST), (3, hn.MOST, 0)]
