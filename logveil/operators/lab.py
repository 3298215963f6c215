"""Why a value was or wasn't masked in a sample, and rules that would mask it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.accept import REASONS, accepted, veto
from ..rules.registry import CATEGORIES, compiles, effective, validate
from . import kernel
from .kernel import MaskConfig
from .masking import dealt

SAMPLE, PROPOSALS, MATCHES = 20_000, 6, 200
#: So many samples and values that return are remembered within a task.
REPEATED = 1024
# Fragments of key names, in order, and the label they imply.
KEY_LABELS = [
    ("password passwd pwd secret token apikey credential passphrase", "SECRET"),
    ("email mail upn smtp", "EMAIL"),
    ("domain realm tenant netbios", "DOMAIN"),
    ("host computer machine device server node asset workstation endpoint agent instance vm", "HOST"),
    ("user account login logon sam principal actor owner member operator analyst employee person", "USER"),
    ("addr ip", "IP"),
    ("group team role", "GROUP"),
    ("org company tenantname", "ORG"),
]
_ADDRESS = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")


@lru_cache(4096)
def label_of_key(key: str) -> str | None:
    name = re.sub("[^a-z]", "", key.lower())
    return next((label for words, label in KEY_LABELS if any(w in name for w in words.split())), None)


def label_of_value(value: str) -> str:
    shapes = [
        (_ADDRESS.pattern, "IP"),
        (r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}", "EMAIL"),
        (r"(?=[^:]*:)[0-9A-Fa-f:]+", "IPV6"),
        (r"(?s).*\\.*", "USER"),
        (r"[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)+", "HOST"),
        (r"(?=.*\d)[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+", "HOST"),
    ]
    return next((label for shape, label in shapes if re.fullmatch(shape, value)), "USER")


def value_class(value: str, quoted: bool) -> str:
    """A narrow pattern for values of this shape."""
    if _ADDRESS.fullmatch(value):
        return r"(?:\d{1,3}\.){3}\d{1,3}"
    if quoted:
        return r"[^\"'\r\n]+"
    for shape in (r"[A-Za-z0-9._@\\\-]+", r"[^\s\"',;]+"):
        if re.fullmatch(shape, value):
            return shape
    return r"[^\t\r\n]{1,80}?(?=[ ]{2,}|\t|$)" if re.fullmatch(r"[^\t\r\n]+", value) else r"[^\r\n]{1,80}"


def anchor(sample: str, start: int, end: int) -> dict:
    """What stands before an occurrence: ``kind`` (xml_data, xml, param, kv, bare), ``key`` and whether it is quoted."""
    before = sample[max(0, start - 120) : start]
    quoted = before[-1:] in ('"', "'") and sample[end : end + 1] in ('"', "'")
    out = {"kind": "bare", "key": None, "quoted": quoted}
    for kind, shape in (("xml_data", r"<Data Name=[\"']([A-Za-z]\w{1,40})[\"']>$"), ("xml", r"<([A-Za-z][\w.\-]{1,40})>$"), ("param", r"(?<![\w-])--?([A-Za-z][A-Za-z0-9\-]{1,30})[ \t]+[\"']?$")):
        if m := re.search(shape, before):
            return out | {"kind": kind, "key": m[1]}
    if m := re.search(r"[\"']?[ \t]*[=:][ \t]*[\"']?$", before):
        head = before[: m.start()]
        # names of several words stand before a colon, as in event texts
        for shape in [r"(?m)(?:^|[ \t]{2,}|\t|[,;(\[{])[ \t]*([A-Za-z][A-Za-z0-9_.\-]*(?: [A-Za-z][A-Za-z0-9_.\-]*){1,2})$", r"([A-Za-z][A-Za-z0-9_.\-]*)$"][":" not in m[0] :]:
            if k := re.search(shape, head):
                return out | {"kind": "kv", "key": k[1]}
    return out


def occurrences(sample: str, value: str) -> list[int]:
    out, at = [], sample.find(value) if value else -1
    while at >= 0:
        out.append(at)
        at = sample.find(value, at + 1)
    return out


@lru_cache(8)
def _config(enabled: tuple[str, ...]) -> MaskConfig:
    return MaskConfig(enabled=enabled)


def _hits(sample: str, start: int, end: int, enabled: tuple[str, ...]) -> list[dict]:
    """The first match of each rule that touches the place."""
    out = []
    views = kernel.Views(sample)
    for category, rule_id, label, pattern in _config(enabled).builtin.worth(views):
        for a, b in pattern.spans(sample):
            if a < end and start < b:
                why = veto(label, sample[a:b])
                out.append({"rule_id": rule_id, "label": label, "matched": sample[a:b], "whole_value": a <= start and b >= end, "accepted": why is None, "category_on": category in enabled, "reason": why and REASONS[why]})
                break
    return out


def _protected(sample: str, start: int, end: int) -> str | None:
    """What of a kept pattern touches the place."""
    views = kernel.Views(sample)
    return next((sample[a:b] for p, _ in kernel.kept_patterns().worth(views) for a, b in p.spans(sample) if a < end and start < b), None)


def diagnose(sample: str, value: str, enabled: tuple[str, ...] = CATEGORIES, brief: bool = False) -> dict:
    """``verdict``: already_masked, protected, claimed_earlier, category_off, rejected or no_match; None with an error where the value isn't in the sample.

    A ``brief`` diagnosis leaves out what the verdict doesn't need: what
    protects a masked value, the hits of one that is masked or protected.
    """
    sample, value = (sample or "")[:SAMPLE], (value or "").strip()
    at = occurrences(sample, value)
    if not at:
        return {"verdict": None, "error": "The value is not in the sample." if value else "No value was given."}
    start, end = at[0], at[0] + len(value)
    masked, _, _ = kernel.mask(sample, _config(tuple(enabled)))
    gone = value not in masked
    kept = None if brief and gone else _protected(sample, start, end)
    hits = [] if brief and (gone or kept is not None) else _hits(sample, start, end, tuple(enabled))
    ladder = [
        ("already_masked", gone),
        ("protected", kept is not None),
        ("claimed_earlier", any(h["accepted"] and h["whole_value"] and h["category_on"] for h in hits)),
        ("category_off", any(h["accepted"] and not h["category_on"] for h in hits)),
        ("rejected", bool(hits)),
        ("no_match", True),
    ]
    around = anchor(sample, start, end)
    return {
        "verdict": next(v for v, so in ladder if so), "error": None, "value": value, "label": label_of_key(around["key"] or "") or label_of_value(value),
        "occurrences": len(at), "anchor": around, "protected_by": kept, "hits": hits[:PROPOSALS], "masked_preview": masked,
    }


def diagnosed(rows: DataFrame, id_col: str = "doc_id", sample_col: str = "sample", value_col: str = "value", enabled: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``<id_col>, verdict, label, occurrences`` of many samples and values; a null verdict where the value isn't in the sample."""
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, verdict string, label string, occurrences int"

    told = (("verdict", pa.string()), ("label", pa.string()), ("occurrences", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(REPEATED)
        def verdict(sample: str, value: str) -> tuple:
            found = diagnose(sample, value, enabled, brief=True)
            return tuple(found.get(k) for k, _ in told)

        for batch in batches:
            found = [verdict((s or "")[:SAMPLE], v) for s, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array([f[k] for f in found], t) for k, (_, t) in enumerate(told)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "verdict", "label", "occurrences"])

    return dealt(rows.select(id_col, sample_col, value_col)).mapInArrow(run, schema)


def _effect(sample: str, value: str, before: dict[str, str], changed: MaskConfig) -> tuple[bool, list[str]]:
    """Whether the value goes, and which values are masked that weren't in the mapping before."""
    new = kernel.mask(sample, changed)
    return value not in new[0], sorted(set(new[1].values()) - set(before.values()) - {value})


def _pattern(around: dict, shape: str) -> str:
    key = re.escape(around["key"] or "")
    return {
        "xml_data": rf"(?i)<Data Name=[\"']{key}[\"']>([^<]+)</Data>",
        "xml": rf"(?i)<{key}>([^<]+)<",
        "param": rf"(?i)(?<![\w-])--?{key}[ \t]+[\"']?({shape})",
        "kv": rf"(?i)\b{key}[\"']?\s*[=:]\s*[\"']?({shape})",
        "bare": rf"\b({shape})",
    }[around["kind"]]


_LIST = re.compile(r"\(\?:(?P<body>[^()+*{}^$]*\|[^()+*{}^$]*)\)")


@lru_cache(4096)
def _widened(regex: str, key: str) -> list[str]:
    """The rule with the key put before each list of field names it has; none where it knows the key. Blanks, hyphens and underscores in the key may be any of them or none."""
    if re.search(rf"(?<!\w){re.escape(key.lower())}", regex.lower()):
        return []
    name = r"[ _\-]?".join(re.escape(part) for part in re.split(r"[ _\-]+", key.strip()) if part)
    wider = (regex[: m.start("body")] + f"{name}|" + regex[m.start("body") :] for m in _LIST.finditer(regex))
    return [r for r in wider if compiles(r) and len(r) <= 2000]


def takes_place(regex: str, sample: str, start: int, end: int) -> bool:
    """Whether the pattern captures what stands there and not much more: at most three times its length, or forty characters more."""
    if not compiles(regex):
        return False
    room = max(3 * (end - start), end - start + 40)
    spans = (m.span(m.lastindex or 0) for m in re.finditer(regex, sample))
    first = next(((a, b) for a, b in spans if a <= start and b >= end), None)
    return first is not None and first[1] - first[0] <= room


#: Marks of a rule that was written for what stands around the value.
_MADE_FOR = {"kv": ("[=:]", r"=\s", r":\s"), "param": ("-(?:", "--?", "-(?i:"), "xml": ("<",), "xml_data": ("<Data",)}


def _fits(around: dict, regex: str) -> bool:
    """Whether a rule is of the family of the value's surroundings; a name of several words is a label at the start of a line."""
    marks = ("(?im)^", "(?m)^") if around["kind"] == "kv" and " " in (around["key"] or "") else _MADE_FOR.get(around["kind"], ())
    return any(mark in regex for mark in marks)


def suggest(sample: str, value: str, enabled: tuple[str, ...] = CATEGORIES) -> dict:
    """The diagnosis, and at most six proposals for a value that no rule masks: a wider built-in, a new pattern, the value itself. Each was tried on the sample."""
    found = diagnose(sample, value, enabled)
    out: list[dict] = []
    if found["verdict"] in ("no_match", "rejected"):
        sample, value, around = sample[:SAMPLE], found["value"], found["anchor"]
        start = occurrences(sample, value)[0]
        end = start + len(value)
        label = found["label"] if accepted(found["label"], value) else "CUSTOM"
        config = _config(tuple(enabled))
        before = kernel.mask(sample, config)[1]
        if around["key"] and label != "CUSTOM":
            tried = []
            for r in effective():
                if r.label == label and r.category in enabled:
                    for wide in _widened(r.regex, around["key"]):
                        if not takes_place(wide, sample, start, end):
                            continue
                        gone, more = _effect(sample, value, before, replace(config, patches={r.rule_id: wide}))
                        if gone:
                            tried.append((not _fits(around, r.regex), len(more), len(wide), {"kind": "extend_builtin", "rule_id": r.rule_id, "label": label, "regex": wide, "also_masked": more}))
                            break
            out += [t[3] for t in sorted(tried, key=lambda t: t[:3])[:2]]
        for kind, regex in (("new_pattern", _pattern(around, value_class(value, around["quoted"]))), ("literal", kernel.literal(value))):
            try:
                validate(regex)
            except ValueError:
                continue
            gone, more = _effect(sample, value, before, replace(config, custom_patterns=({"label": label, "regex": regex},)))
            if gone and takes_place(regex, sample, start, end):
                out.append({"kind": kind, "rule_id": None, "label": label, "regex": regex, "also_masked": more})
    return found | {"proposals": out[:PROPOSALS]}


def try_regex(sample: str, regex: str, label: str = "CUSTOM", enabled: tuple[str, ...] = CATEGORIES) -> dict:
    """What a pattern matches in a sample (200 at most), what of it is accepted, and what it masks that wasn't."""
    validate(regex)
    sample = sample[:SAMPLE]
    spans = [m.span(m.lastindex or 0) for m, _ in zip(re.finditer(regex, sample), range(MATCHES), strict=False)]
    matches = [{"value": sample[a:b], "accepted": (why := veto(label, sample[a:b])) is None, "reason": why and REASONS[why]} for a, b in spans]
    config = MaskConfig(enabled=tuple(enabled))
    before = set(kernel.mask(sample, config)[1].values())
    after = kernel.mask(sample, replace(config, custom_patterns=({"label": label, "regex": regex},)))
    return {"matches": matches, "newly_masked": sorted(set(after[1].values()) - before), "masked_preview": after[0]}


def suggested(rows: DataFrame, id_col: str = "doc_id", sample_col: str = "sample", value_col: str = "value", enabled: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``<id_col>, place, kind, rule_id, label, regex, also_masked`` of the proposals for many samples and values, the best first."""
    kind = rows.schema[id_col].dataType.simpleString()
    names = [id_col, "place", "kind", "rule_id", "label", "regex", "also_masked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposals = lru_cache(REPEATED)(lambda sample, value: suggest(sample, value, enabled).get("proposals", []))
        for batch in batches:
            found = [proposals((s or "")[:SAMPLE], v) for s, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            where = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            flat = [(k, p) for f in found for k, p in enumerate(f, 1)]
            strings = [pa.array([p[n] for _, p in flat], pa.string()) for n in ("kind", "rule_id", "label", "regex")]
            also = pa.array([p["also_masked"] for _, p in flat], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), pa.array([k for k, _ in flat], pa.int32()), *strings, also], names)

    return dealt(rows.select(id_col, sample_col, value_col)).mapInArrow(run, f"`{id_col}` {kind}, place int, kind string, rule_id string, label string, regex string, also_masked array<string>")
