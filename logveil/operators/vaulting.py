"""One numbering for many incidents, without one group for all.

What is known after one incident decides what the next ones hide, so each
depends on all before it. That is solved in rounds: every incident is searched
by itself; each value's first sighting is what an aggregate over all incidents
says; a value is then offered to the later incidents that have its rarest word,
and those whose offers have changed are searched again, until none has. After
``k`` rounds at least the first ``k`` incidents are as they are one after the
other, and in practice two or three rounds do, as known values seldom bring new
ones to light.

Numbers follow from the first sightings: values are sorted by ranges of (label,
sighting), and what each range holds of a label is added up over the ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import kernel
from .kernel import MaskConfig

_WORD = re.compile(r"\w+")
_OTHER = re.compile(r"[^\w\s]")
FOUND = "row long, spans array<struct<start:int,end:int,value:string,label:string>>, vals array<struct<value:string,label:string,last:int>>, words array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("label", pa.string())]))
_VALUES = pa.list_(pa.struct([("value", pa.string()), ("label", pa.string()), ("last", pa.int32())]))
_STRINGS = pa.list_(pa.string())


def words_of(text: str) -> list[str]:
    """Its distinct words, and its other characters but white space: what a known value that stands in it has of them, it has too."""
    return sorted({*_WORD.findall(text), *_OTHER.findall(text)})


def keys_of(value: str) -> list[str]:
    """The words that every text has in which the value stands as one; its other characters where it has no word."""
    return sorted(set(_WORD.findall(value)) or set(_OTHER.findall(value)))


def _searched(rows: DataFrame, config: MaskConfig) -> DataFrame:
    """``FOUND`` of ``rows (row, text, offers)``: spans, the values that they make known, and the words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, values, words = [], [], []
            for text, offers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                known = config.known.extended({f"[{o['label']}_{k}]": o["value"] for k, o in enumerate(offers)}) if offers else None
                found = kernel.detect(text, config, known)
                label_of, last = kernel.labelled(found), {}
                for s in found:
                    last[s.value] = max(last.get(s.value, 0), s.start)
                spans.append([{"start": s.start, "end": s.end, "value": s.value, "label": s.label} for s in found])
                values.append([{"value": v, "label": label_of[v], "last": at} for v, at in last.items() if v not in config.numbering.any_label])
                words.append(words_of(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), pa.array(values, _VALUES), pa.array(words, _STRINGS)], ["row", "spans", "vals", "words"])

    return rows.select("row", "text", "offers").mapInArrow(run, FOUND)


def _keyed(values: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([keys_of(v) for v in batch.column(0).to_pylist()], _STRINGS)], [*batch.schema.names, "keys"])

    return values.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema) + ", keys array<string>")


def _first_sightings(found: DataFrame, places: DataFrame) -> DataFrame:
    """``value, label, place, last`` of each value where it was seen first."""
    each = found.select("row", F.inline("vals")).join(places, "row")
    first = F.struct("place", "label", "last")
    return each.groupBy("value").agg(F.min(first).alias("first")).select("value", "first.label", "first.place", "first.last")


def _offers(values: DataFrame, words: DataFrame, often: DataFrame) -> DataFrame:
    """``row, offers, mark``: the values that a row's text may have, of those seen before it, in the order in which they became known."""
    keys = _keyed(values).withColumn("n_keys", F.size("keys")).withColumn("word", F.explode("keys")).drop("keys").join(often, "word")
    # a value of which some word stands nowhere as a word can't be met again
    rarest = keys.groupBy("value").agg(F.min(F.struct("n", "word")).alias("rarest"), F.count(F.lit(1)).alias("met"), F.first("n_keys").alias("n_keys")).where("met = n_keys").select("value", F.col("rarest.word").alias("word"))
    known = values.join(rarest, "value").withColumnRenamed("place", "since")
    # plain on both sides, so that Spark splits a word that a third of all rows has
    met = words.join(known, "word").where(F.col("since") < F.col("place"))
    offers = F.sort_array(F.collect_list(F.struct("since", (-F.col("last")).alias("after"), "value", "label")))
    out = met.groupBy("row").agg(offers.alias("offers"))
    return out.select("row", F.transform("offers", lambda o: F.struct(o["value"].alias("value"), o["label"].alias("label"))).alias("offers")).withColumn("mark", F.sha2(F.to_json("offers"), 256))


def _numbered(values: DataFrame, config: MaskConfig) -> DataFrame:
    """``value, place, placeholder``: numbers of a label follow first sightings, within an incident from its end backwards."""
    order = [F.col("label"), F.col("place"), F.desc("last")]
    ranged = stored(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))  # a row for each range and label in it
    before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "label", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part", "label").orderBy("at"))
    tops = config.numbering.top
    floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in tops.items() for x in pair]), F.col("label")), F.lit(0)) if tops else F.lit(0)
    n = (F.col("offset") + own + floor).cast("long").cast("string")
    return ranged.join(offsets, ["part", "label"]).select("value", "place", F.concat(F.lit("["), "label", F.lit("_"), n, F.lit("]")).alias("placeholder"))


def vaulted(incidents: DataFrame, config: MaskConfig | None = None) -> DataFrame:
    """``incident_id, ord, masked, mapping`` of ``incidents (incident_id, ord, text)`` under one mapping, as if masked one after the other.

    Incidents stand in the order of ``ord``, nulls first, of equal ones by
    ``incident_id``. ``mapping`` holds the placeholders that a masked text has,
    those among them that stood in it before. Null texts are empty; extra
    columns are ignored; an empty table gives an empty result.
    """
    config = config or MaskConfig()
    rows = stored(incidents.select(F.monotonically_increasing_id().alias("row"), F.col("incident_id").cast("string").alias("incident_id"), F.col("ord").cast("long").alias("ord"), F.coalesce("text", F.lit("")).alias("text")))
    place = F.struct("ord", "incident_id", "row")
    places = rows.select("row", place.alias("place"))
    no_offers = F.array().cast("array<struct<value:string,label:string>>")
    found = stored(_searched(rows.withColumn("offers", no_offers), config).withColumn("mark", F.lit("")))
    words = stored(found.select("row", F.explode("words").alias("word")).join(places, "row"))
    often = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    found = found.drop("words")
    while True:
        values = stored(_first_sightings(found, places))
        offers = stored(_offers(values, words, often))
        marks = found.select("row", "mark").join(offers, "row", "left").where(F.coalesce(offers["mark"], F.lit("")) != found["mark"])
        changed = stored(marks.select("row", F.coalesce("offers", no_offers).alias("offers"), F.coalesce(offers["mark"], F.lit("")).alias("mark")))
        if not changed.take(1):
            break
        again = _searched(rows.join(changed, "row"), config).drop("words").join(changed.select("row", "mark"), "row")
        found = stored(found.join(changed, "row", "left_anti").unionByName(again))
    numbers = stored(_numbered(values, config))
    pair = F.struct("value", "placeholder")
    each = found.select("row", F.explode("vals.value").alias("value")).join(numbers, "value").groupBy("row").agg(F.collect_list(pair).alias("own"))
    # placeholders that stand in a text by themselves are known if they were given by then
    literal = rows.select("row", place.alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[[A-Z0-9]+_[0-9]+\]"), F.lit(0)))).alias("placeholder"))
    stood = literal.join(numbers, "placeholder").where(F.col("place") <= F.col("at")).groupBy("row").agg(F.collect_list(pair).alias("stood"))
    joined = rows.join(found.select("row", "spans"), "row").join(each, "row", "left").join(stood, "row", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = [p for p in config.base_mapping if not kernel.PLACEHOLDER.fullmatch(p)]
        for batch in batches:
            masked, mappings = [], []
            for text, spans, own, stood in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                given = {p["value"]: p["placeholder"] for p in own or ()}
                label_of = kernel.labelled([kernel.Span(s["start"], s["end"], s["value"], s["label"], "") for s in spans])
                known = config.numbering
                name = {v: given.get(v) or known.exact.get((label, v)) or known.any_label.get(v) for v, label in label_of.items()}
                pieces, at = [], 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    pieces += (text[at : s["start"]], name[s["value"]])
                    at = s["end"]
                out = "".join([*pieces, text[at:]])
                there = {m[0] for m in kernel.PLACEHOLDER.finditer(out)}
                all_ = {p: config.base_mapping[p] for p in config.base_mapping if p in there} if there and config.base_mapping else {}
                all_ |= {p: config.base_mapping[p] for p in odd if p in out}
                all_ |= {p["placeholder"]: p["value"] for p in (*(own or ()), *(stood or ())) if p["placeholder"] in there}
                masked.append(out)
                mappings.append(list(all_.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masked, pa.string()), pa.array(mappings, pa.map_(pa.string(), pa.string()))], ["incident_id", "ord", "masked", "mapping"])

    return joined.select("incident_id", "ord", "text", "spans", "own", "stood").mapInArrow(rewrite, "incident_id string, ord long, masked string, mapping map<string,string>")
