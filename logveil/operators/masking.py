"""Masking of a table of texts, and the relational forms of its steps.

The composite runs the kernel once for each row, on Arrow batches; the rest —
values of one rule, places without a UDF, numbering, rewriting, restoring,
spreading known values — are plain expressions, windows and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.accept import veto_column
from ..rules import values as V
from ..rules.registry import LABEL_RANK, NO_RANK
from . import kernel
from .kernel import MaskConfig

SPAN = "struct<start:int,end:int,value:string,label:string,tier:string,rule_id:string,placeholder:string>"
_SPAN = pa.struct([(n, pa.int32() if n in ("start", "end") else pa.string()) for n in ("start", "end", "value", "label", "tier", "rule_id", "placeholder")])


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than cores dealt to all cores: a file of one row group is one task, however many cores there are.

    More files make tasks enough and aren't shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < len(rows.inputFiles()) < cores else rows


def _span_lists(placed: list[list[tuple[kernel.Span, str]] | None]) -> pa.Array:
    """The spans of each text as one list array, built from flat columns."""
    flat = [(*vars(s).values(), p) for spans in placed for s, p in spans or ()]
    columns = [pa.array([f[k] for f in flat], _SPAN.field(k).type) for k in range(len(_SPAN))]
    ends = np.cumsum([0, *(len(p or ()) for p in placed)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SPAN)), mask=pa.array([p is None for p in placed]))


def mask(rows: DataFrame, config: MaskConfig | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``<id_col>, masked, mapping, spans`` and the columns to ``keep`` of every row; a null text stays null."""
    config = config or MaskConfig()
    schema = rows.select(id_col, *keep).schema
    names = [*schema.names, "masked", "mapping", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                done = [None if t is None else kernel.mask(t, config) for t in part.column(part.num_columns - 1).to_pylist()]
                masked = pa.array([d and d[0] for d in done], pa.string())
                mappings = pa.array([d and list(d[1].items()) for d in done], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], masked, mappings, _span_lists([d and d[2] for d in done])], names)

    out = StructType([*schema, *StructType.fromDDL(f"masked string, mapping map<string,string>, spans array<{SPAN}>")])
    return dealt(rows.select(id_col, *keep, F.col(text_col))).mapInArrow(run, out)


def spans(masked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return masked.select(id_col, F.inline("spans"))


def entities(masked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, placeholder, label, n, value`` of the mappings."""
    each = masked.select(id_col, F.explode("mapping").alias("placeholder", "value"))
    return each.select(id_col, "placeholder", F.regexp_extract("placeholder", r"^\[([A-Z0-9]+)_\d+\]$", 1).alias("label"), F.regexp_extract("placeholder", r"_(\d+)\]$", 1).cast("int").alias("n"), "value")


def field_table(masked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, field, placeholder, value`` of the mappings as people read them, by label and number; a user's own labels name themselves."""
    names = F.create_map(*[F.lit(x) for pair in V.FIELD_NAMES.items() for x in pair])
    each = entities(masked, id_col)
    return each.select(id_col, F.coalesce(F.try_element_at(names, F.col("label")), F.col("label")).alias("field"), "placeholder", "value", "label", "n").orderBy(id_col, "label", "n").drop("label", "n")


def java(regex: str) -> str:
    """A rule's pattern for Spark: ``\\n`` alone ends lines, letters are Unicode's, a bracket in a class is itself."""
    out, inside = [], False
    i = 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            out.append("\\" + c if c in "[&" else c)
        else:
            out.append(c)
            if c == "[":
                inside = True
                j = i + 1 + (regex[i + 1 : i + 2] == "^")
                if regex[j : j + 1] == "]":
                    out.append(regex[i + 1 : j] + "\\]")
                    i = j + 1
                    continue
        i += 1
    return "(?dU)" + "".join(out)


def rule(rule_id: str) -> tuple[str, str, int]:
    """Label, pattern for Spark, and group of a built-in rule."""
    import re

    _, _, label, _, regex = next(r for r in V.RULES if r[0] == rule_id)
    return label, java(regex), re.compile(regex).groups


def rule_values(text: Column, rule_id: str) -> Column:
    """All accepted values of one rule, by Catalyst alone."""
    label, regex, group = rule(rule_id)
    return F.filter(F.regexp_extract_all(text, F.lit(regex), F.lit(group)), lambda v: (v != "") & veto_column(F.lit(label), v).isNull())


def places(text: Column, regex: Column) -> Column:
    """``array<struct<start, value>>`` of all matches of a pattern without groups: lengths of the gaps and of the matches before are added up."""
    gaps, found = F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0))

    def size(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda acc, x: acc + F.length(x))

    return F.transform(found, lambda v, i: F.struct((size(F.slice(gaps, 1, i + 1)) + size(F.slice(found, 1, i))).alias("start"), v.alias("value")))


def resolve_labels(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The most specific label of each value; ties go to the claim that came first (``claim``)."""
    ranks = F.create_map(*[F.lit(x) for pair in LABEL_RANK.items() for x in pair])
    rank = F.coalesce(F.try_element_at(ranks, F.col("label")), F.lit(NO_RANK))
    return spans.groupBy(id_col, "value").agg(F.min_by("label", F.struct(rank.alias("rank"), "claim")).alias("label"))


def number(spans: DataFrame, id_col: str = "doc_id", floors: DataFrame | None = None) -> DataFrame:
    """``<id_col>, label, value, n, placeholder`` of ``spans (id, label, value, start)``: values count from the one that occurs last.

    ``floors (label, n)`` continues a numbering.
    """
    last = spans.groupBy(id_col, "label", "value").agg(F.max("start").alias("last"))
    n = F.row_number().over(Window.partitionBy(id_col, "label").orderBy(F.desc("last"))).cast("long")
    if floors is not None:
        last = last.join(floors.select("label", F.col("n").alias("floor")), "label", "left")
        n = n + F.coalesce("floor", F.lit(0))
    return last.select(id_col, "label", "value", n.alias("n")).withColumn("placeholder", F.concat(F.lit("["), "label", F.lit("_"), F.col("n").cast("string"), F.lit("]")))


def rewrite(text: Column, spans: Column) -> Column:
    """``text`` with each of ``spans`` (structs ``start, end, placeholder``, by position, apart) replaced."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["placeholder"]).alias("out"), s["end"].cast("int").alias("at")),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def unmask(text: Column, mapping: Column) -> Column:
    """Placeholders replaced one after the other, the longest first."""
    ordered = F.array_sort(F.map_entries(mapping), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return F.aggregate(ordered, text, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def spread(rows: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences of known values as tokens: ``<id_col>, value, label, n``, by an equi-join of tokens."""
    token = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(java(V.TOKEN)), F.lit(0)))
    tokens = rows.select(id_col, token.alias("t")).withColumn("value", F.regexp_replace("t", r"[.\-@$]+$", ""))
    counts = tokens.groupBy(id_col, "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known.select(id_col, "value", "label"), [id_col, "value"])


def register(spark, config: MaskConfig | None = None) -> None:
    """``mask_text(text)``, ``unmask_text(text, map)``, ``is_accepted(label, value)`` and the table function ``detect_spans(id, text)`` for SQL."""
    from pyspark.sql.functions import pandas_udf, udtf

    from ..functions.accept import accepted

    config = config or MaskConfig()

    @pandas_udf("string")
    def mask_text(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else kernel.mask(t, config)[0])

    @pandas_udf("boolean")
    def is_accepted(label: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([accepted(a or "", b or "") for a, b in zip(label, value, strict=True)])

    @udtf(returnType="id string, start int, end int, value string, label string, rule_id string, placeholder string")
    class DetectSpans:
        def eval(self, id, text):
            for s, p in kernel.mask(text or "", config)[2]:
                yield str(id), s.start, s.end, s.value, s.label, s.rule_id, p

    spark.udf.register("mask_text", mask_text)
    # as ``unmask``, in the plan of the query that calls it
    spark.sql(
        "create or replace temporary function unmask_text(text string, mapping map<string,string>) returns string return "
        "aggregate(array_sort(map_entries(coalesce(mapping, map())), (a, b) -> length(b.key) - length(a.key)), text, (acc, e) -> replace(acc, e.key, e.value))"
    )
    spark.udf.register("is_accepted", is_accepted)
    spark.udtf.register("detect_spans", DetectSpans)
