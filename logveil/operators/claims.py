"""Masking by rules without Python: candidate spans as rows, claims as interval selection.

Every pattern gives its matches by position: a pattern is taken apart around its
value, so that lengths of the gaps between matches, of what stands before the
value in a match, and of the value add up to its place (a running sum over the
matches of a text). Candidates of all patterns of a text then claim characters
in the order of the patterns: those that touch each other make islands, found
by a running maximum of ends, and in each island the candidates are taken
greedily, so that the work of a text grows with its candidates and not with
their pairs. All steps are by text, after one shuffle.

Tiers here are the kept terms and patterns, custom terms, custom patterns and
built-in rules, in the kernel's order. Delimited cells, PowerShell shapes, known
values and the spreading of found values are the kernel's alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.accept import veto_column
from ..rules import values as V
from ..rules.registry import clean_label, compiles
from ..session import stored
from . import masking
from .kernel import MaskConfig

_FLAGS = re.compile(r"\(\?[a-z]+\)")
_BACK = re.compile(r"\\([1-9])")


def taken_apart(regex: str) -> tuple[str, int]:
    """The pattern with a group for what stands before its value and one for the value, and the number of the latter.

    The value is the last group that isn't inside another one, of a pattern
    without groups the whole match.
    """
    flags = m[0] if (m := _FLAGS.match(regex)) else ""
    body = regex[len(flags) :]
    open_: list[tuple[int, bool]] = []
    groups: list[tuple[int, int]] = []  # of the outermost level
    inner, inside, i = 0, False, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            i += 1 + (body[i + 1 : i + 2] == "^")
            i += body[i : i + 1] == "]"
            continue
        elif c == "(":
            open_.append((i, body[i + 1 : i + 2] != "?"))
        elif c == ")":
            start, captures = open_.pop()
            if captures and not open_:
                groups.append((start, i))
            elif captures:
                inner += 1
        i += 1
    if not groups and not inner:
        return f"{flags}()({body})", 2
    if not groups or inner:
        raise ValueError("its groups lie inside each other or in a branch")
    start, end = groups[-1]
    whole = f"({body[:start]})({body[start + 1 : end]}){body[end + 1 :]}"
    return flags + _BACK.sub(lambda m: f"\\{int(m[1]) + 1}", whole), 1 + len(groups)


@dataclass(frozen=True)
class Step:
    """A pattern in the order of claims; kept ones have no label."""

    tier: str
    rule_id: str | None
    label: str | None
    regex: str  # Python's


def steps(config: MaskConfig, rules: tuple[str, ...] | None = None) -> list[Step]:
    """All patterns of a configuration, of the built-in rules only ``rules`` where given."""

    def word_edges(term: str) -> str:
        edge = [c.isalnum() or c == "_" for c in (term[0], term[-1])]
        return "(?i)" + (r"(?<!\w)" if edge[0] else "") + re.escape(term) + (r"(?!\w)" if edge[1] else "")

    def longest(terms: tuple[str, ...]) -> list[str]:
        return sorted({t.strip() for t in terms if t.strip()}, key=lambda t: (-len(t), t))

    out = [Step("kept", None, None, word_edges(t)) for t in longest(config.keep_terms)]
    out += [Step("kept", None, None, k) for k in V.KEEP_PATTERNS]
    out += [Step("term", None, "CUSTOM", "(?i)" + re.escape(t)) for t in longest(config.custom_terms)]
    out += [Step("pattern", None, clean_label(p["label"]), p["regex"]) for p in config.custom_patterns if compiles(p["regex"])]
    known = [(rid, label, category, config.overrides.get(rid) or regex) for rid, _, label, category, regex in V.RULES]
    return out + [Step("rule", rid, label, regex) for rid, label, category, regex in known if category in config.enabled and (rules is None or rid in rules)]


def _matches(text: Column, rank: int, step: Step) -> Column:
    """``array<struct<rank, at, gap, found, head, value>>`` of one pattern; texts without a match are not taken apart."""
    regex, group = taken_apart(step.regex)
    pattern = F.lit(masking.java(regex))
    found, heads, values = (F.regexp_extract_all(text, pattern, F.lit(k)) for k in (0, 1, group))
    gaps = F.split(text, pattern, -1)
    each = F.transform(
        found,
        lambda whole, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("at"), F.length(F.get(gaps, i)).alias("gap"), F.length(whole).alias("found"), F.length(F.get(heads, i)).alias("head"), F.get(values, i).alias("value")
        ),
    )
    return F.when(text.rlike(masking.java(step.regex)), each)


def candidates(rows: DataFrame, order: list[Step]) -> DataFrame:
    """``row, rank, start, end, value`` of all matches of the patterns in ``rows (row, text)``, vetoed values left out."""
    text = F.col("text")
    each = F.flatten(F.filter(F.array(*[_matches(text, k, s) for k, s in enumerate(order)]), lambda a: a.isNotNull()))
    found = rows.select("row", F.inline(each)).repartition("row")
    before = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("found")).over(before), F.lit(0)) + F.col("gap") + F.col("head")
    placed = found.withColumn("start", start.cast("int")).select("row", "rank", "start", (F.col("start") + F.length("value")).cast("int").alias("end"), "value")
    label = F.get(F.array(*[F.lit(s.label).cast("string") for s in order]), F.col("rank"))
    return placed.where(label.isNull() | veto_column(label, F.col("value")).isNull())


def claimed(found: DataFrame, keys: tuple[str, ...] = ("row",)) -> DataFrame:
    """Of ``found (*keys, rank, start, end, value)`` the spans that get their characters: the least rank first, of one rank the first place."""
    before = Window.partitionBy(*keys).orderBy("start", "rank", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("first").over(before.rowsBetween(Window.unboundedPreceding, 0))
    parted = found.withColumn("first", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int")).withColumn("island", island)
    one = F.struct("rank", "start", "end", "value")
    each = parted.groupBy(*keys, "island").agg(F.array_sort(F.collect_list(one)).alias("found"))
    none = F.array().cast("array<struct<rank:int,start:int,end:int,value:string>>")
    kept = F.aggregate(
        "found",
        none,
        lambda taken, s: F.when(F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), taken).otherwise(F.concat(taken, F.array(s))),
    )
    return each.select(*keys, F.inline(kept))


def _named(spans: DataFrame, order: list[Step]) -> DataFrame:
    def of(name: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(s, name)).cast("string") for s in order]), F.col("rank")).alias(name)

    return spans.select("*", of("label"), of("tier"), of("rule_id")).where("tier <> 'kept'")


def spans(rows: DataFrame, config: MaskConfig | None = None, rules: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, start, end, value, label, tier, rule_id`` of all spans; rows with a null text have none."""
    order = steps(config or MaskConfig(), rules)
    numbered = rows.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    return _named(claimed(candidates(numbered, order)), order).select(F.col("row").alias(id_col), "start", "end", "value", "label", "tier", "rule_id")


def mask(rows: DataFrame, config: MaskConfig | None = None, rules: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, masked`` of every row, numbered and rewritten like the kernel does, by Catalyst alone; a null text stays null."""
    order = steps(config or MaskConfig(), rules)
    numbered = stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found = stored(_named(claimed(candidates(numbered.select("row", "text"), order)), order))
    labels = masking.resolve_labels(found.withColumn("claim", F.struct("rank", "start")), "row")
    given = masking.number(found.drop("label").join(labels, ["row", "value"]), "row").select("row", "value", "placeholder")
    placed = found.join(given, ["row", "value"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("spans"))
    both = numbered.join(placed, "row", "left")
    return both.select(F.col("id").alias(id_col), F.when(F.col("spans").isNull(), F.col("text")).otherwise(masking.rewrite(F.col("text"), F.col("spans"))).alias("masked"))


def trial(rows: DataFrame, proposals: list[tuple[str, str, str]], config: MaskConfig | None = None, rules: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``proposal, <id_col>, value``: what each of ``proposals (name, label, regex)`` masks in a whole table that wasn't masked before.

    Each proposal claims before the rules, like a custom pattern. Candidates of
    the rules are found once; the values of each text with and without the
    proposal are compared as sets of rows.
    """
    config = config or MaskConfig()
    order = steps(config, rules)
    at = next((k for k, s in enumerate(order) if s.tier == "rule"), len(order))
    new = [Step("pattern", name, clean_label(label), regex) for name, label, regex in proposals]
    order = order[:at] + new + order[at:]
    numbered = rows.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    found = stored(candidates(numbered, order))
    of_proposal = (F.col("rank") >= at) & (F.col("rank") < at + len(new))
    base = found.where(~of_proposal)
    names = F.array(*[F.lit(n) for n, _, _ in proposals])
    with_each = base.withColumn("proposal", F.explode(names)).unionByName(found.where(of_proposal).withColumn("proposal", F.get(names, F.col("rank") - at)))
    before = _named(claimed(base), order).select("row", "value").distinct()
    after = _named(claimed(with_each, ("row", "proposal")), order).select("row", "proposal", "value").distinct()
    return after.join(before, ["row", "value"], "left_anti").select("proposal", F.col("row").alias(id_col), "value")


def side_effects(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``place, proposal, n_values, n_texts`` of a trial's rows: the proposal that masks the fewest new values first, of equal ones by name."""
    each = found.groupBy("proposal").agg(F.countDistinct("value").alias("n_values"), F.countDistinct(id_col).alias("n_texts"))
    return each.withColumn("place", F.row_number().over(Window.orderBy("n_values", "n_texts", "proposal")))  # a row for each proposal
