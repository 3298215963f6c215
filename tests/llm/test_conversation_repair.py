import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logveil.llm import conversation_repair as cr
from logveil.llm import queries

FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
KINDS = "conv_id long, turn long, role string, text string"


def plan(rows):
    """Cheapest edits of (must go, initial, cut) rows, by a table of (cost, audit, roles) for each last initial, row after row."""

    def inserted(table):
        for _ in range(2):
            for s, to, role in (("", "u", "user"), ("s", "u", "user"), ("u", "a", "assistant"), ("a", "u", "user")):
                if s in table:
                    c, audit, edits = table[s]
                    found = (c + 2, audit + "I", [*edits, role])
                    table[to] = min(table.get(to, found), found)
        return table

    table = {"": (0, "", [])}
    for goes, initial, cut in rows:
        after = {}

        def put(s, found):
            after[s] = min(after.get(s, found), found)  # noqa: B023

        for s, (c, audit, edits) in inserted(dict(table)).items():
            put(s, (c + 3, audit + "D", [*edits, None]))
            if not goes:
                to = "a" if s == "u" else "u"
                put(to, (c + 2 + cut, audit + "R", [*edits, {"u": "user", "a": "assistant"}[to]]))
                if s + initial in ("s", "u", "su", "ua", "au") and initial:
                    put(initial, (c + cut, audit + "K", [*edits, True]))
        table = after
    ends = inserted(dict(table))
    return min(ends[s] for s in ("", "a") if s in ends)


def brute(rows):
    """``FIELDS`` of one conversation of (turn, role, text) rows in order."""
    seen, bad = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        bad.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, edits = plan([(b in ("blank", "duplicate"), r[1][:1], int(b == "truncated")) for r, b in zip(rows, bad)])
    out, left = [], iter(rows)
    for name, edit in zip(audit, edits):
        if name == "I":
            out.append(f"{edit}:")
            continue
        _, role, text = next(left)
        if name != "D":
            out.append(f"{role if edit is True else edit}:{text}")
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *(bad.count(b) for b in ("blank", "duplicate", "truncated")), wrong, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def made(n, seed, roles=("user", "assistant", "system", "tool")):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", " ", "", "Why?", "x\n.", "So. "]
    return [(k + (k > 3), rng.choice(roles), rng.choice(texts) + rng.choice(["", str(rng.randrange(n)) + "."])) for k in range(n)]


def found(frame, id_col="conv_id"):
    return {r[id_col]: tuple(r[f] for f in FIELDS) for r in frame.collect()}


@pytest.mark.parametrize("n", range(5))
def test_search_against_every_sequence_of_edits(n):
    """All edits up to a length, tried one after the other in ASCII order."""
    rng = random.Random(n)
    for _ in range(30):
        rows = [(rng.random() < 0.2, rng.choice("suax"), rng.randrange(2)) for _ in range(n)]
        best = None
        for size in range(n, n + 4):
            for audit in itertools.product("DIKR", repeat=size):
                if sum(a != "I" for a in audit) != n or audit.count("I") > 3:
                    continue
                cost, s, i, good = 0, "", 0, True
                for a in audit:
                    nxt = "a" if s == "u" else "u"
                    if a == "I":
                        cost, s = cost + 2, nxt
                        continue
                    goes, initial, cut = rows[i]
                    i += 1
                    if a == "D":
                        cost += 3
                    elif goes or (a == "K" and s + initial not in ("s", "u", "su", "ua", "au")):
                        good = False
                        break
                    else:
                        cost, s = cost + cut + 2 * (a == "R"), initial if a == "K" else nxt
                if good and s in ("", "a"):
                    best = min(best or (cost, audit), (cost, audit))
        cost, audit, _ = cr.cheapest(rows)
        assert (cost, audit) == (best[0], "".join(best[1])) == plan(rows)[:2]


def test_search_against_a_table_on_long_conversations():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(rng.random() < 0.1, rng.choice("uauauasx"), rng.randrange(4) == 0) for _ in range(rng.randrange(5, 120))]
        assert cr.cheapest(rows)[:2] == plan(rows)[:2]


@pytest.mark.parametrize(("size", "parts"), [(None, None), (3, 5), (1, 7)])
def test_segments_of_any_size(spark, size, parts, monkeypatch):
    monkeypatch.setattr(cr, "FAN", 2)
    talks = {1: made(90, 1), 2: made(7, 2), 3: made(1, 3), 4: [(0, "user", "Same."), *[(k, "user", "Same.") for k in range(40)]], 5: made(33, 5, ("assistant", "user"))}
    rows = [(c, *r) for c, talk in talks.items() for r in talk]
    random.Random(9).shuffle(rows)
    got = found(cr.repair(spark.createDataFrame(rows, KINDS), segment_rows=size, parts=parts))
    assert got == {c: brute(sorted(talk)) for c, talk in talks.items()}


def test_scan(spark):
    rows = [("x", p, s, [10 * p + s]) for p in range(9) for s in range(p % 3 + 1)] + [("y", 4, 0, [1])]
    frame = spark.createDataFrame(rows, "conv string, part long, seq long, value array<bigint>")
    for reverse in (False, True):
        order = sorted(rows, reverse=reverse)
        want = {}
        for c, p, s, _ in rows:
            before = [v[3][0] for v in itertools.takewhile(lambda v: v[:3] != (c, p, s), (v for v in order if v[0] == c))]  # noqa: B023
            want[c, p, s] = (before[::-1] if reverse else before) or None
        got = {(r.conv, r.part, r.seq): r.value for r in cr.scanned(frame, lambda a, b: a + b, reverse, fan=2).collect()}
        assert got == want


def test_edges(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "b."), (1, 0, "user", "a."), (1, 0, "assistant", "a."), (None, 5, "user", "Hm?"), (None, 9, "assistant", "x" * 70_000), (2, 3, "", "Role."),
        (3, 1, "user", "Zoë sagt \U0001f600"), (3, 1, "user", "Zoë sagt \U0001f600"), (3, 2, "assistant", "y. "), (4, 0, "system", "Only."),
    ]
    frame = spark.createDataFrame(rows, KINDS)
    for clash in ("conv", "part", "seq", "row", "head", "digest", "whole", "turns", "copy"):
        frame = frame.withColumn(clash, F.lit("clash"))
    want = {}
    for c in {r[0] for r in rows}:
        talk = [(t, r or " " if r is None else r, " " if x is None else x) for i, t, r, x in rows if i == c]
        want[c] = brute(sorted(talk, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))
    assert found(cr.repair(frame)) == want
    assert cr.repair(frame.limit(0)).collect() == []


def test_conversations(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").collect()
    talks = {r.conv_id: [] for r in rows}
    for r in rows:
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        talks[r.conv_id] += [(r.turn, "user" if kind == 4 else r.role, text)] * {0: 0, 3: 2}.get(kind, 1)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: brute(sorted(talk)) if talk else empty for c, talk in talks.items()}
    assert found(queries.QUERIES["op13_conversation_repair"](spark, small)) == want


def test_damage_of_nulls(spark):
    rows = [(c, t, None, None) for c in (None, 1, 2, 3) for t in (None, 4, 5, 6, 7)]
    got = cr.damaged(spark.createDataFrame(rows, KINDS)).collect()
    want = []
    for c, t, _, _ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [(c, t, "user" if kind == 4 else " ", "" if kind == 1 else " ")] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
