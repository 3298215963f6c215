import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logveil.llm import packing, queries

WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute(sizes, length, most):
    """Sequences of (document, start, length) of one task's documents, by lists and linear search; and what stays open, in a row."""
    done, windows = [], []
    for d, n in enumerate(sizes):
        at = 0
        while n - at >= length:
            done.append([(d, at, length)])
            at += length
        while at < n:
            free = lambda w: length - sum(p[2] for p in w)
            fits = [w for w in windows if free(w) >= n - at]
            if fits:
                w = min(fits, key=lambda w: (free(w), w.number))
            elif len(windows) < most:
                w = Window()
                w.number = brute.count = brute.count + 1
                windows.append(w)
            else:
                w = min(windows, key=lambda w: (free(w), w.number))
            taken = min(free(w), n - at)
            w.append((d, at, taken))
            at += taken
            if not free(w):
                windows.remove(w)
                done.append(list(w))
    windows.sort(key=lambda w: (length - sum(p[2] for p in w), w.number))
    return done, [p for w in windows for p in w]


brute.count = 0


class Window(list):
    number = 0


def checked(pieces, ids, length):
    """Every id of ``ids`` (by document) in one piece, offsets without gaps, sequences full or a power of two long."""
    of, where = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own = np.frombuffer(p.ids, "<u4").tolist()
        assert len(own) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        of[p.doc_id].append((p.start, own))
        where[p.sequence_id].append((p.offset, p.length))
    assert {d: [x for _, own in sorted(v) for x in own] for d, v in of.items()} == {d: v for d, v in ids.items() if v}
    assert all(start == sum(len(o) for s, o in v if s < start) for v in of.values() for start, _ in v)
    totals = []
    for v in where.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        totals.append(at)
    short = [t for t in totals if t != length]
    assert all(t & (t - 1) == 0 and t < length for t in short) and len(set(short)) == len(short)
    return totals


@pytest.mark.parametrize(("length", "most"), [(16, 3), (10, 1), (64, 8)])
def test_one_task_is_best_fit(spark, length, most):
    rng = random.Random(length)
    sizes = [rng.choice([0, 1, 2, 3, 5, 7, 11, 15, 16, 17, 40, 150]) for _ in range(300)]
    ids = {d: [1000 * d + k for k in range(n)] for d, n in enumerate(sizes)}
    frame = spark.createDataFrame(list(ids.items()), "doc_id long, ids array<int>").coalesce(1)
    pieces = packing.packed(frame, length, most).collect()
    checked(pieces, ids, length)
    found = collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        found[p.sequence_id].append((p.doc_id, p.start, p.length))
    full, left = brute(sizes, length, most)
    assert [found[k] for k in sorted(found)][: len(full)] == full
    assert sum(p[2] for p in left) == sum(p[2] for k in sorted(found)[len(full) :] for p in found[k])


def test_leftovers_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 3)
    ids = {d: list(range(d % 7 + 1)) for d in range(200)}
    frame = spark.createDataFrame(list(ids.items()), "doc_id long, ids array<int>").repartition(40)
    totals = checked(packing.packed(frame, 32, 4).collect(), ids, 32)
    assert sum(t < 32 for t in totals) <= 5


def test_documents(spark, small):
    pieces = queries.QUERIES["op12_packing"](spark, small).collect()
    library = Tokenizer.from_file(WORDS)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    total = 0
    of = collections.defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
    assert of.keys() == docs.keys()
    for d, text in docs.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        total += len(ids)
        for p in of[d]:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids)
        assert sum(p.length for p in of[d]) == len(ids)
    ends = collections.Counter()
    for p in pieces:
        ends[p.sequence_id] += p.length
    assert sum(ends.values()) == total and max(ends.values()) <= 4096
    assert all(n & (n - 1) == 0 for n in ends.values())  # so nothing is padded


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "wort " * 30_000), (5, "same"), (5, "same"), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for clash in ("ids", "part", "sequence", "offset", "start", "short", "length"):
        frame = frame.withColumn(clash, F.lit("clash"))
    pieces = packing.pack_documents(frame, WORDS, end_id=2).collect()
    library = Tokenizer.from_file(WORDS)
    assert sum(p.length for p in pieces) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert {p.doc_id for p in pieces} == {1, 2, 3, 4, 5, None}
    bare = packing.pack_documents(frame.where("doc_id < 3"), WORDS).collect()
    assert bare == [] and packing.pack_documents(frame.limit(0), WORDS, end_id=2).collect() == []
