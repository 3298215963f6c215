"""Repair of a conversation's structure by iterative-deepening A*.

A conversation is well formed if the initials of its roles read
``(s?(ua)+)?``. Each row is kept (K), gets another role (R) or goes (D), and
rows without text may be inserted (I); the cheapest edits win, of equally cheap
ones those whose initials are least in ASCII order. The search goes through the
edits depth first in that order, within a bound on the cost; a table holds for
every state (row, last role) that has failed the least that it will cost, so no
state is searched twice within the same means, and the bound rises to what the
start will cost at least, until a path is accepted, which is the answer. What a
state costs at least is told by the rows that must go, the sentences that are
cut off and the pairs of neighbours that can't stay.

Rows are dealt out by ranges of (conversation, turn), so that a conversation
with any share of all rows is many segments of at most ``ROWS`` rows. A
conversation that lies in one segment is searched there. Of longer ones each
segment gives the least costs between its states before and after; a scan of
these by a tree gives what remains behind each segment, each segment is then
searched from all four states before it, and a second scan, of the states that
each of these ends in, tells which one it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, give_back, written

ROWS, BYTES = 128, 4 << 20  # of a segment at most (one row at least)
FAN = 64  # tasks, or groups of them, that one step of a scan joins
HEAD = 256  # characters of a text that order rows of one turn and role, before its digest does

NEVER = 1 << 60
START, S, U, A = range(4)  # state: the initial of the last role so far
NEXT = (U, U, A, U)  # what may be inserted, or be made of a row
ROLE = {U: "user", A: "assistant"}
LEGAL = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ENDS = (0, NEVER, NEVER, 0)
KEEP, RENAME, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
SHAPES = "su", "ua", "au"

Row = tuple[bool, str, int]  # must go, initial of the role, 1 if cut off


def faults(roles: list[str], texts: list[str], before: frozenset[bytes] | set[bytes] = frozenset()) -> list[str]:
    """``blank``, ``duplicate``, ``truncated`` or nothing for each row; ``before``: digests of what earlier segments hold."""
    seen: set[bytes] = set()
    out = []
    for role, text in zip(roles, texts, strict=True):
        key = digest(role, text)
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if key in seen or key in before else "truncated" if last not in ".!?" else "")
        seen.add(key)
    return out


def digest(role: str, text: str) -> bytes:
    raw = role.encode("utf-8", "surrogatepass")
    return hashlib.sha256(b"%d:" % len(raw) + raw + text.encode("utf-8", "surrogatepass")).digest()


def shaped(roles: list[str], found: list[str]) -> list[Row]:
    return [(f in ("blank", "duplicate"), r[:1], int(f == "truncated")) for r, f in zip(roles, found, strict=True)]


def cheapest(rows: list[Row], entry: int = START, ends: tuple[int, ...] = ENDS, last: bool = True, table: dict[int, int] | None = None) -> tuple[int, str, int]:
    """Cost, audit and last state of the cheapest edits from ``entry`` on, ``NEVER`` where none is accepted.

    ``ends``: what is still to be paid after each state. Rows are inserted
    after the last one only if it is the conversation's (``last``). ``table``
    may be shared by searches that differ in ``entry`` alone.
    """
    n = len(rows)
    known = {} if table is None else table
    # what the rows from each on cost at least, and the first of them that needn't go
    after, first = [min(ends)] * (n + 1), [n] * (n + 1)
    s_left = [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        goes, initial, cut = rows[i]
        s_left[i] = s_left[i + 1] or (not goes and initial == "s")
        if goes:
            after[i], first[i] = after[i + 1] + DELETE, first[i + 1]
        else:
            j = first[i + 1]
            pair = j < n and initial + rows[j][1] not in SHAPES
            after[i], first[i] = after[i + 1] + cut + pair, i
    wanted = [x for x in range(4) if ends[x] < NEVER]
    low = min(wanted, default=4)

    def least(i: int, s: int) -> int:
        if low > A or (max(wanted) < U and s > max(wanted)) or (wanted == [S] and s == START and not s_left[i]) or (wanted == [START] and s != START):
            return NEVER
        j = first[i]
        return after[i] + (j < n and (s, rows[j][1]) not in LEGAL)

    def bound_of(i: int, s: int) -> int:
        key = 4 * i + s
        if key not in known:
            known[key] = least(i, s)
        return known[key]

    def edits(i: int, s: int) -> list[tuple[str, int, int, int]]:
        """Initial, cost and the state after it, in ASCII order."""
        out = [("D", DELETE, i + 1, s)] if i < n else []
        if i < n or last:
            out.append(("I", INSERT, i, NEXT[s]))
        if i < n and not rows[i][0]:
            _, initial, cut = rows[i]
            to = LEGAL.get((s, initial))
            if to is not None:
                out.append(("K", KEEP + cut, i + 1, to))
            out.append(("R", RENAME + cut, i + 1, NEXT[s]))
        return out

    while (means := bound_of(0, entry)) < NEVER:
        # frames: row, state, means left, edits, number of the next edit
        path: list[str] = []
        stack = [[0, entry, means, None, 0]]
        while stack:
            frame = stack[-1]
            i, s, left, options, k = frame
            if options is None:
                if i == n and ends[s] <= left:
                    return means - left + ends[s], "".join(path), s
                frame[3] = options = edits(i, s)
            if k < len(options):
                frame[4] += 1
                name, cost, j, to = options[k]
                if cost + bound_of(j, to) <= left:
                    path.append(name)
                    stack.append([j, to, left - cost, None, 0])
                continue
            # failed: it costs more than was left
            most = min([c + bound_of(j, to) for _, c, j, to in options] + ([ends[s]] if i == n else []), default=NEVER)
            known[4 * i + s] = max(known[4 * i + s], min(most, NEVER))
            stack.pop()
            if stack:
                path.pop()
    return NEVER, "", START


def repaired(roles: list[str], texts: list[str], audit: str, entry: int = START) -> list[str]:
    """``role:text`` of the rows that the edits of ``audit`` leave."""
    out, i, s = [], 0, entry
    for edit in audit:
        if edit == "I":
            s = NEXT[s]
            out.append(f"{ROLE[s]}:")
            continue
        if edit == "K":
            s = LEGAL[s, roles[i][:1]]
            out.append(f"{roles[i]}:{texts[i]}")
        elif edit == "R":
            s = NEXT[s]
            out.append(f"{ROLE[s]}:{texts[i]}")
        i += 1
    return out


def illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in SHAPES or not a or not b for a, b in zip(roles, roles[1:]))


# --- scans over the segments of a conversation ------------------------------------------------------------------------


def scanned(parts: DataFrame, combine: Callable[[Any, Any], Any], reverse: bool = False, fan: int | None = None) -> DataFrame:
    """``conv, part, seq, value``: of each of ``parts (conv, part, seq, value array<long>)`` what those before it combine to, null for the first.

    With ``reverse``, those behind it. ``combine`` is associative; order is
    (part, seq). A group holds what one ``part`` has of a conversation, then
    what ``fan`` of these groups give, and so on: sums go up the tree, and what
    is before each group comes down again.
    """
    fan = fan or FAN
    fields = "conv string, part long, seq long, value array<bigint>"
    columns = [c.split()[0] for c in fields.split(", ")]
    order = [("part", "descending" if reverse else "ascending"), ("seq", "descending" if reverse else "ascending")]
    both = (lambda a, b: combine(b, a)) if reverse else combine

    def table(rows: list[tuple]) -> pa.Table:
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(columns, types, strict=True))})

    def up(key, group):
        total = None
        for value in group.sort_by(order).column("value").to_pylist():
            total = value if total is None else both(total, value)
        return table([(key[0].as_py(), key[1].as_py(), 0, total)])

    def down(key, group, above):
        now = above.column("value").to_pylist()[0] if above.num_rows else None
        out = []
        for conv, part, seq, value in zip(*(c.to_pylist() for c in group.sort_by(order).columns), strict=True):
            out.append((conv, part, seq, now))
            now = value if now is None else both(now, value)
        return table(out)

    levels = [written(parts.select(*columns))]
    group = F.col("part")
    while True:
        levels.append(written(levels[-1].groupBy("conv", group.alias("group")).applyInArrow(up, fields)))
        if not (levels[-1].agg(F.max("part")).first()[0] or 0):
            break
        group = F.floor(F.col("part") / fan)
    before = None
    for k in range(len(levels) - 2, -1, -1):
        own = levels[k].withColumn("group", F.floor(F.col("part") / fan) if k else F.col("part"))
        above = (levels[k + 1].where("false") if before is None else before).withColumnRenamed("part", "group")
        before = own.groupBy("conv", "group").cogroup(above.groupBy("conv", "group")).applyInArrow(lambda key, a, b: down(key, a.select(columns), b), fields)
        before = written(before)
    return before


def least_sums(a: list[int], b: list[int]) -> list[int]:
    """The min-plus product of two four by four tables."""
    x, y = np.array(a).reshape(4, 4), np.array(b).reshape(4, 4)
    return np.minimum((x[:, :, None] + y[None, :, :]).min(axis=1), NEVER).ravel().tolist()


def chained(a: list[int], b: list[int]) -> list[int]:
    """First one table of states, then the other."""
    return [b[x] for x in a]


# --- rows to segments to conversations --------------------------------------------------------------------------------

SEGMENT = "conv string, part long, seq long, whole boolean, turns array<bigint>, roles array<string>, texts array<string>"
DONE = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def segments(rows: DataFrame, most: int | None = None, parts: int | None = None) -> DataFrame:
    """Written segments of ``rows (conv, turn, role, text)`` in order; ``whole``: it surely is the whole conversation."""
    limit = most or ROWS
    # equal rows are dealt out too, so the order ends in a number of the row
    keyed = rows.withColumns({"head": F.substring("text", 1, HEAD), "digest": F.sha2("text", 256), "row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "head", "digest", "row")]
    dealt = (keyed.repartitionByRange(parts, *order) if parts else keyed.repartitionByRange(*order)).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        conv, first, turns, roles, texts, size = None, True, [], [], [], 0
        out: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            strings = pa.list_(pa.string())
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), strings, strings)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["conv", "part", "seq", "whole", "turns", "roles", "texts"])

        began = True  # the segment begins its conversation, as far as this task has seen
        held = 0
        for b in batches:
            for c, turn, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv or len(turns) >= limit or size >= BYTES:
                    if turns:
                        out.append((conv, part, seq, c != conv and began and not first, turns, roles, texts))
                        held += size
                        seq += 1
                    if c != conv:
                        first, began = conv is None, True  # the first one may have begun in the task before
                    else:
                        began = False
                    conv, turns, roles, texts, size = c, [], [], [], 0
                    if held >= BYTES or len(out) >= 1000:
                        yield batch(out)
                        out, held = [], 0
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                size += len(text)
        if turns:
            out.append((conv, part, seq, False, turns, roles, texts))
        if out:
            yield batch(out)
        give_back()

    return written(dealt.select("conv", "turn", "role", "text").mapInArrow(cut, SEGMENT), compression="zstd")


def gaps(turns: list[int | None]) -> int:
    some = {t for t in turns if t is not None}
    return max(some) - min(some) + 1 - len(some) if some else 0


def _whole(segments: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turns, roles, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = faults(roles, texts)
                cost, audit, _ = cheapest(shaped(roles, found))
                text = "\n".join(repaired(roles, texts, audit))
                sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, gaps(turns), *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal(roles), cost, audit, sha))
            yield _done(out)

    return segments.select("conv", "turns", "roles", "texts").mapInArrow(run, DONE)


def _done(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), *[pa.int64()] * 6, pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in DONE.split(", ")])


WAYS = "conv string, part long, seq long, value array<bigint>, audits array<string>, costs array<bigint>"
PIECE = "conv string, part long, seq long, turns array<bigint>, ends array<string>, counts array<bigint>, cost long, audit string, text binary"


def _parted(parts: DataFrame) -> DataFrame:
    """Conversations of several segments."""
    rows = parts.select("conv", "part", "seq", F.inline(F.arrays_zip("roles", "texts")))
    # digests that an earlier segment of the conversation has
    key = F.unhex(F.sha2(F.concat(F.encode(F.concat(F.octet_length("roles").cast("string"), F.lit(":")), "utf-8"), F.col("roles").cast("binary"), F.col("texts").cast("binary")), 256))
    held = written(rows.select("conv", "part", "seq", key.alias("digest")).distinct())
    place = F.struct("part", "seq")
    firsts = written(held.groupBy("conv", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    late = by_key(held, firsts, ["conv", "digest"], "n").where(F.col("first") < place)
    late = late.groupBy("conv", "part", "seq").agg(F.collect_list("digest").alias("late"))  # of one segment
    known = written(parts.join(late, ["conv", "part", "seq"], "left").select("conv", "part", "seq", "turns", "roles", "texts", "late"), compression="zstd")

    def rows_of(roles: list[str], texts: list[str], late: list[bytes] | None) -> tuple[list[str], list[Row]]:
        found = faults(roles, texts, set(late or ()))
        return found, shaped(roles, found)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for roles, texts, late in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True):
                shape = rows_of(roles, texts, late)[1]
                tables: list[dict[int, int]] = [{} for _ in range(4)]
                ends = [tuple(0 if x == y else NEVER for y in range(4)) for x in range(4)]
                values.append([cheapest(shape, e, ends[x], False, tables[x])[0] for e in range(4) for x in range(4)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(values, pa.list_(pa.int64()))], ["conv", "part", "seq", "value"])

    scan = "conv string, part long, seq long, value array<bigint>"
    given = ("conv", "part", "seq", "roles", "texts", "late")
    behind = scanned(known.select(*given).mapInArrow(costs, scan), least_sums, reverse=True)
    found = written(known.join(behind, ["conv", "part", "seq"]).select(*given, F.col("value").alias("behind")), compression="zstd")
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finish = [0, 2 * INSERT, INSERT, 0]  # what is inserted after each state to end well
        for batch in batches:
            states, audits, paid = [], [], []
            for roles, texts, late, behind in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5, 6)), strict=True):
                shape = rows_of(roles, texts, late)[1]
                ends = ENDS if behind is None else tuple(min(NEVER, min(behind[4 * s + x] + finish[x] for x in range(4))) for s in range(4))
                table: dict[int, int] = {}
                ways = [cheapest(shape, e, ends, behind is None, table) for e in range(4)]
                states.append([w[2] for w in ways])
                audits.append([w[1] for w in ways])
                paid.append([w[0] - (ends[w[2]] if w[0] < NEVER else 0) for w in ways])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(states, longs), pa.array(audits, pa.list_(pa.string())), pa.array(paid, longs)], [c.split()[0] for c in WAYS.split(", ")])

    tried = written(found.select(*given, "behind").mapInArrow(searched, WAYS))
    entries = scanned(tried.select("conv", "part", "seq", "value"), chained).select("conv", "part", "seq", F.coalesce(F.get("value", F.lit(START)), F.lit(START)).cast("int").alias("entry"))
    chosen = tried.join(entries, ["conv", "part", "seq"]).select("conv", "part", "seq", "entry", F.get("audits", "entry").alias("audit"), F.get("costs", "entry").alias("cost"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, seq, turns, roles, texts, late, entry, audit, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bad = rows_of(roles, texts, late)[0]
                some = [t for t in turns if t is not None]
                kept = repaired(roles, texts, audit, entry)
                text = "\n".join(kept).encode("utf-8", "surrogatepass") if kept else None
                counts = [len(set(some)), *(bad.count(f) for f in ("blank", "duplicate", "truncated")), illegal(roles)]
                out.append((conv, part, seq, [min(some), max(some)] if some else [], [roles[0][:1], roles[-1][:1]], counts, cost, audit, text))
            types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [c.split()[0] for c in PIECE.split(", ")])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        sha, some, turns, initial, sums, cost, audits = hashlib.sha256(), False, [], None, [0] * 5, 0, []

        def end() -> pa.RecordBatch:
            gap = turns[1] - turns[0] + 1 - sums[0] if turns else 0
            return _done([(now, gap, sums[1], sums[2], sums[3], sums[4], cost, "".join(audits), sha.hexdigest())])

        for batch in batches:
            for conv, _, _, span, ends, counts, paid, audit, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if now is not None:
                        yield end()
                    now, sha, some, turns, initial, sums, cost, audits = conv, hashlib.sha256(), False, [], None, [0] * 5, 0, []
                elif initial + ends[0] not in SHAPES:
                    sums[4] += 1
                initial = ends[1]
                sums = [a + b for a, b in zip(sums, counts, strict=True)]
                if span:
                    sums[0] -= bool(turns) and turns[1] == span[0]  # a turn in both segments
                    turns = [turns[0] if turns else span[0], span[1]]
                cost += paid
                audits.append(audit)
                if text is not None:
                    sha.update(b"\n" * some + text)
                    some = True
        if now is not None:
            yield end()

    all_ = known.join(chosen, ["conv", "part", "seq"]).select("conv", "part", "seq", "turns", "roles", "texts", "late", "entry", "audit", "cost")
    ordered = written(all_.mapInArrow(pieces, PIECE), compression="zstd").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return ordered.mapInArrow(whole, DONE)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int | None = None, parts: int | None = None) -> DataFrame:
    """``<id_col>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation.

    Rows stand in the order of their turns, nulls first; those of one turn by
    role, then text (its first ``HEAD`` characters, then its digest). Of each
    row the first fault counts: blank (nothing but ASCII white space), a
    duplicate (role and text seen before), cut off (its last character but for
    white space isn't ``.``, ``!`` or ``?``). Blank rows and duplicates must go.
    A role of no letters, or of another initial, can't be kept. Null roles and
    texts count as one space; rows without a conversation's id are one
    conversation with a null id; extra columns are ignored; an empty table
    gives an empty result. The hash of a conversation's text is sequential by
    definition, so of a long conversation one task reads the repaired
    segments, one row for each, as a stream.
    """
    conv = F.coalesce(F.concat(F.lit("#"), F.col(id_col).cast("string")), F.lit(""))
    plain = [F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    stored = segments(rows.select(conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), *plain), segment_rows, parts)
    open_ = stored.where("not whole")
    done = _whole(stored.where("whole")).unionByName(_parted(open_))
    kind = rows.schema[id_col].dataType
    id_ = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind)
    return done.withColumn(id_col, id_).select(id_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """One row in twenty is dropped, emptied, robbed of its stops, repeated or given to the user each, by its conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damaged(rows))
    ids = rows.select("conv_id").distinct()
    both = ids.alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    longs = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return both.select("i.conv_id", *longs, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


#: The same by a table of the cheapest edits for each state, row after row; the first two steps are CRC-32.
OP13_SQL = r"""
with recursive codes as (
    select [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) for n in range(256)] as t
), kinds as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(list_reduce(list_prepend(4294967295::bigint, [ascii(c)::bigint for c in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')]),
            lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 as kind
    from conversations, codes
), damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from (select *, unnest(case when kind = 3 then [1, 2] else [1] end) as copy from kinds where kind <> 0)
), ordered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged
), judged as (
    select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
        when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
        when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
        role[1] as own, lag(role[1]) over (partition by conv_id order by i) as before
    from ordered
), counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || own not in ('su', 'ua', 'au')) as illegal, count(*) as n
    from judged group by conv_id
), inserts(state, k, after_, cost_, audit_, text_) as (values
    ('', 0, '', 0, '', ''), ('s', 0, 's', 0, '', ''), ('u', 0, 'u', 0, '', ''), ('a', 0, 'a', 0, '', ''),
    ('', 1, 'u', 2, 'I', chr(10) || 'user:'), ('s', 1, 'u', 2, 'I', chr(10) || 'user:'), ('a', 1, 'u', 2, 'I', chr(10) || 'user:'), ('u', 1, 'a', 2, 'I', chr(10) || 'assistant:'),
    ('', 2, 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 2, 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), edits as (
    select conv_id, i, state, 'D' as edit, 3 as cost, state as to_, '' as text from judged, (select distinct state from inserts) union all
    select conv_id, i, state, 'R', 2 + (fault = 'truncated')::int, case when state = 'u' then 'a' else 'u' end, chr(10) || case when state = 'u' then 'assistant:' else 'user:' end || text
    from judged, (select distinct state from inserts) where fault not in ('blank', 'duplicate') union all
    select conv_id, i, state, 'K', (fault = 'truncated')::int, own, chr(10) || role || ':' || text
    from judged, (select distinct state from inserts) where fault not in ('blank', 'duplicate') and state || own in ('s', 'u', 'su', 'ua', 'au') and own <> ''
), walked as (
    select conv_id, 0::bigint as i, '' as state, {'cost': 0::bigint, 'audit': '', 'text': ''} as best from counted
    union all
    select w.conv_id, w.i + 1, e.to_, min({'cost': w.best.cost + x.cost_ + e.cost, 'audit': w.best.audit || x.audit_ || e.edit, 'text': w.best.text || x.text_ || e.text})
    from walked w join inserts x on x.state = w.state join edits e on e.conv_id is not distinct from w.conv_id and e.i = w.i + 1 and e.state = x.after_
    group by w.conv_id, w.i + 1, e.to_
), ended as (
    select conv_id, min({'cost': w.best.cost + x.cost_, 'audit': w.best.audit || x.audit_, 'text': w.best.text || x.text_}) as best
    from walked w join inserts x on x.state = w.state and x.after_ in ('', 'a') join counted c using (conv_id) where w.i = c.n group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    coalesce(e.best.cost, 0) as cost, coalesce(e.best.audit, '') as audit, sha256(coalesce(e.best.text[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id
"""
