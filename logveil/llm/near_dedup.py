"""Near-duplicates by an LSH forest over MinHash signatures.

A document's set holds the hashes of its distinct five-word runs. Rows are
numbered, and those with equal sets have one representative row. Its signature
is cut into ``TREES`` labels of ``DEPTH`` minima; each tree orders all labels,
regions are common prefixes of at least ``ROOT`` minima. A region of more than
``CROWD`` members is parted by the next byte of its labels, and again, until
its parts fit, so the depth follows how crowded the region is; each part's first
member is a candidate of the first member of the region. In a region that fits
every representative is a candidate of its neighbour in label order, with which
it has the longest common prefix there, and of the first member. Where more than
``CROWD`` whole labels are equal, their order says nothing, and they are dealt
into slices tied to the same first member. Candidates are
confirmed on the full sets, in groups of about ``WEIGHT`` shingles, to which
every text needed is sent once; links within what is connected already are
skipped.

The forest finds most links but bounds the partners of a representative, so
what it misses is found by a prefix-filtered set join of whatever it has left
in different components: in one order of all shingles, two sets that are near
enough have a shingle in common among their first ``n - ceil(t n) + 1``. Where
at most ``LIST`` representatives have such a shingle, the pairs of different
components that its place in both still allows are confirmed or excluded;
longer lists that hold several components are joined to bundles, each of which
is filtered by prefixes in its own order. The order puts common shingles last
(counts of one in ``SAMPLED`` representatives, in ``LEVELS`` steps); it decides
how much is compared, never what is found. The smallest id that the links reach
names the component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_key, chunks, give_back, lean, mix, most_rows, numbered, shingle_hashes, token_hashes, utf8, written
from .components import components

TREES, DEPTH, ROOT = 16, 6, 3
WORDS = 5
CROWD = 1000  # members of a region at most, and of a slice of equal labels
WEIGHT = 250_000  # shingles of a group that confirms links
SENT = 500_000  # rows of the list of needed texts that may be broadcast
WIDE = 25_000  # rows with signatures in one file of few tasks
SAMPLED, LEVELS = 4, (2, 8, 32, 128)  # so many of one in SAMPLED representatives have a shingle of a level
CELLS = 24  # bits of a hash that tell a shingle's level
LIST = 32  # representatives with one shingle of whom each pair is a row
BUNDLE = 400_000  # shingles that are compared in one group; larger bundles are dealt by size, then in blocks

_SEEDS = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIP, _TIMES = _SEEDS[: TREES * DEPTH], _SEEDS[TREES * DEPTH :] | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of each text, in a row, and where each begins (one more entry)."""
    hashes, at = shingle_hashes(*token_hashes(texts), WORDS)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    kept = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return hashes[new], kept[at]


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of a mix of each minimum, big-endian so that bytes order as numbers; only for sets with members."""
    some = at[:-1][np.diff(at) > 0]
    out = np.empty((len(some), TREES * DEPTH), ">u2")
    for j in range(TREES * DEPTH):
        out[:, j] = mix(np.minimum.reduceat((sets ^ _FLIP[j]) * _TIMES[j], some)) >> np.uint64(48)
    return out


def sketch(rows: DataFrame) -> DataFrame:
    """``row, id, n_shingles, print, sig`` of ``rows (row, id, text)``: size and 128-bit fingerprint of the set and its signature (null where empty)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            for a, b in chunks(texts):
                sets, at = shingle_sets(texts[a:b])
                size = np.diff(at)
                prints: list[bytes | None] = [None] * (b - a)
                sigs: list[bytes | None] = [None] * (b - a)
                some = np.flatnonzero(size)
                if len(some):
                    begin = at[some]
                    two = np.stack([np.add.reduceat(mix(sets + np.uint64(1)), begin), np.bitwise_xor.reduceat(mix(sets ^ _SEEDS[0]), begin)], axis=1)
                    for i, p, s in zip(some.tolist(), two, signatures(sets, at), strict=True):
                        prints[i], sigs[i] = p.tobytes(), s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], ["row", "id", "n_shingles", "print", "sig"])

    return rows.select("row", "id", "text").mapInArrow(lean(of), "row long, id long, n_shingles long, print binary, sig binary")


def candidates(reps: DataFrame) -> DataFrame:
    """``a, b, hub, most, fewest`` of ``reps (rep, n_shingles, sig)``: pairs ``a < b``; ``hub`` is the least first member that they met under, ``most`` and ``fewest`` the shingles of the two."""
    size = 2 * DEPTH
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", t * size + 1, size).alias("label")) for t in range(TREES)])
    rows = reps.select("rep", "n_shingles", F.inline(trees))
    member = F.struct("rep", "n_shingles")
    found = None

    def met(regions: DataFrame, slices: Column) -> DataFrame:
        """Neighbours in label order, and the first member with each."""
        keys = ["tree", "region", "slice"]
        order = Window.partitionBy(*keys).orderBy("label", "rep")
        near = regions.withColumn("slice", slices).withColumn("near", F.lag(member).over(order)).withColumn("leader", F.min(member).over(Window.partitionBy(*keys)))
        return near.select("rep", "n_shingles", F.col("leader.rep").alias("hub"), F.explode(F.array("leader", "near")).alias("o"))

    for depth in range(2 * ROOT, size + 1):
        level = rows.withColumn("region", F.substring("label", 1, depth))
        counts = level.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("members"), F.min(member).alias("first")).where(F.col("members") > CROWD)
        crowded = written(counts)
        many = crowded.count()
        if depth > 2 * ROOT:  # parts of a crowded region, tied to its first member
            firsts = level.groupBy("tree", "region").agg(F.min(F.struct(member.alias("own"), F.col("above"))).alias("x"))
            found = found.unionByName(firsts.select(F.col("x.own.rep").alias("rep"), F.col("x.own.n_shingles").alias("n_shingles"), F.col("x.above.rep").alias("hub"), F.col("x.above").alias("o")))
            level = level.drop("above")
        if many:
            keys = crowded.select("tree", "region")
            fitting = level.join(F.broadcast(keys) if many <= SENT else keys, ["tree", "region"], "left_anti")
        else:
            fitting = level
        more = met(fitting, F.lit(0).cast("long"))
        found = more if found is None else found.unionByName(more)
        if not many:
            break
        rows = written(by_key(level, crowded.withColumnRenamed("first", "above"), ["tree", "region"], "members").select("rep", "n_shingles", "tree", "label", "above", "members"))
        if depth == size:
            dealt = F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / CROWD))
            equal = met(rows.withColumn("region", F.col("label")), dealt).unionByName(rows.select("rep", "n_shingles", F.col("above.rep").alias("hub"), F.col("above").alias("o")))
            found = found.unionByName(equal)
        rows = rows.drop("members")
    found = found.where("o.rep <> rep")
    return found.groupBy(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b")).agg(
        F.min("hub").alias("hub"), F.min(F.greatest("n_shingles", "o.n_shingles")).alias("most"), F.min(F.least("n_shingles", "o.n_shingles")).alias("fewest")
    )


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The ``pairs (a, b, hub, most)`` whose full sets have 100 * intersection >= percent * union, less those that others imply.

    ``docs``: ``rep, text``, each ``rep`` once; ``most``: the shingles of the
    larger one. Pairs of one hub go to one group, where those of a hub weigh
    at most ``WEIGHT``; of heavier ones, of which there are fewer than groups,
    each is dealt to several.
    """
    links, total = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("most"), F.lit(0))).first()
    if not links:
        return pairs.select("a", "b")
    groups = max(1, -(-total // WEIGHT))
    hubs = pairs.groupBy("hub").agg(F.sum("most").alias("weight"))
    heavy = F.broadcast(hubs.where(F.col("weight") > max(WEIGHT, total // 100_000)).select("hub", F.ceil(F.col("weight") / WEIGHT).alias("slices")))
    dealt = pairs.join(heavy, "hub", "left").select(
        "a",
        "b",
        F.when(F.col("slices").isNotNull(), F.xxhash64("hub", F.pmod(F.xxhash64("b"), F.col("slices")))).otherwise(F.pmod(F.xxhash64("hub"), F.lit(groups))).alias("group"),
    )
    dealt = written(dealt, links)
    need = dealt.toDF("a", "b", "in_group").select(F.col("in_group").alias("group"), F.explode(F.array("a", "b")).alias("rep")).distinct()
    n = 2 * links  # at most
    if n <= SENT:
        texts = docs.join(F.broadcast(need), "rep").select("group", "rep", "text")
    else:  # a first member may be needed by many groups
        need = written(need, n)
        wanted = written(need.groupBy("rep").agg(F.count(F.lit(1)).alias("times")), n)
        often = F.broadcast(wanted.where(F.col("times") > most_rows(n)).select("rep"))
        texts = need.join(F.broadcast(docs.join(often, "rep")), "rep").unionByName(need.join(often, "rep", "left_anti").join(docs, "rep")).select("group", "rep", "text")

    def confirm(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("rep").to_pylist()
        sets, at = shingle_sets(utf8(left.column("text").combine_chunks()))
        place = {d: i for i, d in enumerate(ids)}
        root = list(range(len(ids)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        size = np.diff(at).tolist()
        links = []
        for a, b in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True):
            i, j = place[a], place[b]
            links.append((abs(size[i] - size[j]), i, j))
        out = []
        for _, i, j in sorted(links):
            few, many = sorted((size[i], size[j]))
            x, y = top(i), top(j)
            if x == y or 100 * few < percent * many:
                continue
            both = len(np.intersect1d(sets[at[i] : at[i + 1]], sets[at[j] : at[j + 1]], assume_unique=True))
            if 100 * both >= percent * (few + many - both):
                root[max(x, y, key=ids.__getitem__)] = min(x, y, key=ids.__getitem__)
                out.append(j)
                out.append(i)
        linked = sorted(set(out))
        give_back()
        return pa.table({"a": pa.array([ids[top(i)] for i in linked], pa.int64()), "b": pa.array([ids[i] for i in linked], pa.int64())})

    return texts.groupBy("group").cogroup(dealt.groupBy("group")).applyInArrow(confirm, "a long, b long").where("a <> b")


def common_shingles(docs: DataFrame) -> np.ndarray:
    """For each of 2 ** ``CELLS`` values of a hash the highest of ``LEVELS`` that a shingle of ``docs (rep, text)`` there reaches."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(texts[a:b])[0].view(np.int64))], ["shingle"])

    some = docs.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(lean(of), "shingle long")
    often = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEVELS[0])
    level = sum((F.col("n") >= k).cast("int") for k in LEVELS)
    # two levels of a cell share a byte; 2 ** CELLS / 2 rows at most
    cell = F.shiftrightunsigned("shingle", 64 - CELLS)
    levels = often.groupBy(F.shiftright(cell, 1).alias("byte")).agg(*[F.max(F.when(cell.bitwiseAND(F.lit(1)) == k, level).otherwise(0)).alias(f"l{k}") for k in (0, 1)])
    got = levels.select("byte", (F.col("l0") + 16 * F.col("l1")).cast("short").alias("two")).toArrow()
    out = np.zeros(1 << (CELLS - 1), np.uint8)
    out[got.column("byte").to_numpy()] = got.column("two").to_numpy()
    return out


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Members that a set near enough to one of ``n`` has at least, and that they have in common at least."""
    return -(-n * percent // 100)


def prefixes(docs: DataFrame, percent: int, common: np.ndarray) -> DataFrame:
    """``shingle, at, rep``: the first shingles of each set of ``docs (rep, text)``; sets too small to be near an unequal one have none."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = utf8(batch.column(1)), batch.column(0).to_numpy()
            for a, b in chunks(texts):
                sets, at = shingle_sets(texts[a:b])
                size = np.diff(at)
                cell = (sets >> np.uint64(64 - CELLS)).astype(np.int64)
                late = (sent.value[cell >> 1] >> ((cell & 1) * 4).astype(np.uint8)) & 15
                owner = np.repeat(np.arange(len(size)), size)
                by = np.lexsort((sets, late, owner))
                first = size - _least(size, percent) + 1
                first[(_least(size, percent) == size) & (size * 100 // percent == size)] = 0
                place = np.arange(len(sets)) - at[owner]
                kept = place < first[owner]
                here = by[kept]
                yield pa.RecordBatch.from_arrays([pa.array(sets[here].view(np.int64)), pa.array(place[kept].astype(np.int32)), pa.array(keys[a:b][owner[here]])], ["shingle", "at", "rep"])

    return docs.select("rep", "text").mapInArrow(lean(of), "shingle long, at int, rep long")


def near_pairs(sets: np.ndarray, at: np.ndarray, component: np.ndarray, own: np.ndarray, other: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components of which one is ``own`` and one ``other``, as many as connect what is near.

    By prefixes in the order of how many of these sets have a member, the
    rarest first; what shares one is compared in full.
    """
    size = np.diff(at)
    by = np.argsort(size, kind="stable")
    _, ids, times = np.unique(sets, return_inverse=True, return_counts=True)
    rarest = np.empty(len(times), np.int64)
    rarest[np.argsort(times, kind="stable")] = np.arange(len(times))
    ids = np.concatenate([np.sort(rarest[ids[at[i] : at[i + 1]]]) for i in by])
    size, own, other = size[by], own[by], other[by]
    at = np.append(0, np.cumsum(size))
    _, root = np.unique(component[by], return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)
    first = np.arange(len(ids)) - at[owner] < (size - _least(size, percent) + 1)[owner]
    member, held = ids[first], owner[first]
    order = np.lexsort((held, member))
    member, held = member[order], held[order]
    begin, end = np.searchsorted(member, ids, "left"), np.searchsorted(member, ids, "right")
    reach = at[:-1] + size - _least(size, percent) + 1
    last = np.searchsorted(size, size * 100 // percent, "right")
    mark = np.zeros(len(times), bool)
    out = []
    for i in range(len(size)):
        # later sets of a fitting size, larger or equal
        met = [held[begin[k] : end[k]] for k in range(at[i], reach[i]) if end[k] - begin[k] > 1]
        if not met:
            continue
        j = np.unique(np.concatenate(met))
        j = j[(j > i) & (j < last[i])]
        j = j[(root[j] != root[i]) & ((own[i] & other[j]) | (other[i] & own[j]))]
        if not len(j):
            continue
        mark[ids[at[i] : at[i + 1]]] = True
        near = []
        for k in j.tolist():
            both = int(mark[ids[at[k] : at[k + 1]]].sum())
            if 100 * both >= percent * (size[i] + size[k] - both):
                near.append(k)
        mark[ids[at[i] : at[i + 1]]] = False
        for k in near:
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                out.append((int(by[i]), int(by[k])))
    return out


def completed(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``a, b`` links that connect the ``reps (rep, n_shingles, component)`` of different components that are near.

    ``docs``: ``rep, text`` of the representatives.
    """
    # so many that reading the texts again takes less than keeping them
    first = prefixes(docs, percent, common_shingles(docs))
    shared = written(first.groupBy("shingle").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("shingle"))
    most = shared.count()
    met = written(first.join(F.broadcast(shared) if most <= SENT else shared, "shingle").join(reps, "rep"))
    lists = met.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("members"), F.min("rep").alias("hub")).where("least < most").drop("most")
    lists = written(lists, most)
    two = F.col("members") * (F.col("members") - 1) / 2
    most, long = lists.agg(F.sum(F.when(F.col("members") <= LIST, two).cast("long")), F.sum(F.when(F.col("members") > LIST, F.col("members")))).first()
    short, x, y = lists.where(F.col("members") <= LIST).select("shingle", "hub"), met.alias("x"), met.alias("y")
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    # what both have from their first common shingle on
    rest = F.least(n - F.col("x.at"), m - F.col("y.at"))
    pairs = short.join(x, "shingle").join(y, "shingle").where((F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")))
    pairs = pairs.where((F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest * (100 + percent) >= percent * (n + m)))
    pairs = written(pairs.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.min("hub").alias("hub"), F.max(F.greatest(n, m)).alias("most")), most or 0)
    links = confirmed(docs, pairs, percent)
    if not long:
        return links
    met = written(met.join(lists.where(F.col("members") > LIST).select("shingle", "least"), "shingle").select("rep", "n_shingles", "component", "least").distinct(), long)
    bundles = components(met.select(F.col("component").alias("a"), F.col("least").alias("b")))
    # a bundle holds whole components, but of them only members that share a prefix with another one
    members = written(met.select("rep", "n_shingles", "component").distinct().join(bundles.select(F.col("node").alias("component"), F.col("component").alias("bundle")), "component"), long)
    sizes = written(members.groupBy("bundle").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight")), long)
    groups = max(1, -(-(sizes.agg(F.sum("weight")).first()[0] or 0) // BUNDLE))
    all_ = by_key(members, sizes, ["bundle"], "members")
    yes = F.lit(True)
    small = all_.where(F.col("weight") <= BUNDLE).select("rep", "component", "bundle", F.pmod(F.xxhash64("bundle"), F.lit(groups)).alias("group"), yes.alias("own"), yes.alias("other"))
    # sizes of a pair lie in one band or in two beside each other
    band = F.floor(F.log("n_shingles") / -np.log(percent / 100 - 1e-9))
    banded = all_.where(F.col("weight") > BUNDLE).withColumn("band", band)
    banded = written(banded.select("rep", "n_shingles", "component", "bundle", F.inline(F.array(F.struct(F.col("band").alias("band"), yes.alias("lower")), F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("lower"))))))
    blocks = banded.groupBy("bundle", "band").agg(F.ceil(F.sum("n_shingles") / BUNDLE).cast("long").alias("blocks"), F.count(F.lit(1)).alias("rows"), F.bool_or("lower").alias("needed")).where("needed")
    banded = by_key(banded, written(blocks), ["bundle", "band"], "rows").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "partner"), F.greatest("block", "partner")
    dealt = small.unionByName(banded.select("rep", "component", "bundle", F.xxhash64("bundle", "band", low, high).alias("group"), (F.col("block") == low).alias("own"), (F.col("block") == high).alias("other")))
    dealt = written(dealt)
    side = F.broadcast(dealt) if dealt.count() <= SENT else dealt
    texts = docs.join(side, "rep").select("group", "rep", "component", "bundle", "own", "other", "text")

    def confirm(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("bundle", "ascending")])
        ids, bundle, component = (group.column(c).to_numpy() for c in ("rep", "bundle", "component"))
        own, other = (group.column(c).to_numpy() for c in ("own", "other"))
        cuts = np.append(np.flatnonzero(np.append(True, bundle[1:] != bundle[:-1])), len(bundle))
        out = []
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            sets, at = shingle_sets(utf8(group.column("text").slice(x, y - x).combine_chunks()))
            out += [(ids[x + i], ids[x + j]) for i, j in near_pairs(sets, at, component[x:y], own[x:y], other[x:y], percent)]
        give_back()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return links.unionByName(texts.groupBy("group").applyInArrow(confirm, "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """``<id_col>, n_shingles, component_id, kept`` of every row.

    Null, empty and blank texts have no shingles and link with nothing; a text
    of fewer than five words is one shingle. Rows are judged by their own text
    where an id repeats, and each is in the result; a row without an id is
    judged and links others, but never names a component (without other rows
    it has a null one and is not kept). With ``key_col``, a number that no two
    rows share, the result has that column and ``stays``: true for one row of
    each component, that of the smallest id, of equal ids the smallest key.
    Extra columns are ignored; an empty table gives an empty one.
    """
    id_, text = F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    rows = docs.select(F.col(key_col).cast("long").alias("row"), id_, text) if key_col else numbered(docs.select(id_, text), "row")
    sketches = written(sketch(rows))
    some = sketches.where("n_shingles > 0")
    total = some.count()
    named_by = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    groups = written(some.groupBy("print").agg(F.min("row").alias("rep"), F.min_by("n_shingles", "row").alias("n_shingles"), F.min_by("sig", "row").alias("sig"), F.min(named_by).alias("first"), F.count(F.lit(1)).alias("rows")), total, WIDE)
    pairs = written(candidates(groups.select("rep", "n_shingles", "sig")).where(F.col("fewest") * 100 >= F.col("most") * percent).drop("fewest"), 2 * TREES * total)
    texts = rows.select(F.col("row").alias("rep"), "text")
    links = written(confirmed(texts, pairs, percent))
    named = written(components(links), total)
    reps = written(groups.join(named, F.col("rep") == F.col("node"), "left").select("rep", "n_shingles", F.coalesce("component", "rep").alias("component")), total)
    others = written(some.select(F.col("row").alias("rep")).join(reps, "rep", "left_anti"), total)
    others = F.broadcast(others) if others.count() <= SENT else others
    more = written(completed(texts.join(others, "rep", "left_anti"), reps, percent))
    if more.take(1):
        named = written(components(links.unionByName(more)), total)
    linked = written(groups.join(named, F.col("rep") == F.col("node")).select("print", "first", "component"), total)
    whole = written(linked.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("prints")), linked.count())
    least = by_key(linked.select("print", "component"), whole, ["component"], "prints").select("print", "least")
    known = written(groups.select("print", "rows", "first").join(least, "print", "left").select("print", "rows", F.coalesce("least", "first").alias("first")), total)
    out = by_key(some.select("row", "id", "n_shingles", "print"), known, ["print"], "rows", total).select("row", "id", "n_shingles", "first")
    out = out.unionByName(sketches.where("n_shingles = 0").select("row", "id", "n_shingles", named_by.alias("first")))
    component = F.col("first.id")
    columns = [F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (component.eqNullSafe(F.col("id")) & F.col("id").isNotNull()).alias("kept")]
    return out.select(*columns, *([F.col("row").alias(key_col), (F.col("first.row") == F.col("row")).alias("stays")] if key_col else []))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, percent=85)
