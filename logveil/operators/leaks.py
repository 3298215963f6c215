"""Residue in masked text, by detectors that share nothing with the rules.

Seven detectors, in order: known values, custom terms, IPv4, mailboxes, long
hex, tokens of high entropy, names of assets. Findings of one kind and value
(whatever its case) count once; 25 stay by the order of detectors, then of
places; the result is by severity and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules.registry import CATEGORIES

MOST = 25
# Patterns, harmless tokens and prefixes.
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
MAILBOX = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
HEX = r"\b[A-Fa-f0-9]{32,}\b"
TOKEN = r"\b[A-Za-z0-9+/_\-]{20,}\b"
ASSET = r"(?<![%\w.\-/\\])[A-Z][A-Z0-9]+(?:-[A-Z0-9]+)+\b"
SAFE = (
    "utf-8 iso-8859-1 sha-1 sha-256 sha-384 sha-512 aes-128 aes-192 aes-256 rsa-2048 rsa-4096 tls-1 "
    "ssl-3 http-1 http-2 oauth-2 crc-32 base-64 e-164 rfc-5424 iso-27001 soc-2 pci-dss x-509"
).split()
SAFE_PREFIXES = "cve- ms- kb- rfc- ta00 t10 t11 t12 t13 t14 t15 t16".split()
CLASSES = ("Win32_", "MSFT_", "CIM_", "Msvm_")
ENTROPY = 3.3


def entropy(token: Column) -> Column:
    """Bits of a character of ``token``."""
    letters = F.split(token, "")
    size = F.length(token).cast("double")
    share = F.transform(F.array_distinct(letters), lambda c: (size - F.length(F.replace(token, c, F.lit("")))) / size)
    return -F.aggregate(share, F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def _times(text: Column, token: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("long")


def _edge(value: Column) -> Column:
    """The value as a pattern that doesn't match inside a word."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    left = F.when(value.rlike(r"^(?U)\w"), F.lit(r"(?U)(?<!\w)")).otherwise(F.lit("(?U)"))
    return F.concat(left, quoted, F.when(value.rlike(r"(?U)\w$"), F.lit(r"(?!\w)")).otherwise(F.lit("")))


def _first(values: Column) -> Column:
    """The first 25 values that differ in more than case."""

    def add(kept: Column, v: Column) -> Column:
        fresh = (F.size(kept) < MOST) & ~F.exists(kept, lambda k: F.lower(k) == F.lower(v))
        return F.when(fresh, F.array_append(kept, v)).otherwise(kept)

    return F.aggregate(F.array_distinct(values), F.array().cast("array<string>"), add)


def _rows(values: Column, detector: int, kind: str, severity: str, count, detail) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(
            F.lit(detector).alias("detector"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), v.alias("value"), count(v).cast("long").alias("count"), detail(v).alias("detail"),
        ),
    )


def findings(t: Column, known: Column | None = None, custom_terms: list[str] = (), enabled: tuple[str, ...] = CATEGORIES, keep_terms: list[str] = ()) -> Column:
    """``array<struct<detector, type, severity, value, count, detail>>`` of one text, without leaving its row.

    ``known``: ``array<struct<placeholder, value>>`` of values that were
    masked; kept terms silence known values and assets alone.
    """
    kept = [x.strip().lower() for x in keep_terms if x.strip()]

    def all_of(regex: str) -> Column:
        return F.regexp_extract_all(t, F.lit(f"(?dU){regex}"), F.lit(0))

    def said(text: str):
        return lambda v: F.lit(text)

    def matches(found: Column):
        return lambda v: F.size(F.filter(found, lambda x: x == v))

    parts = []
    if known is not None:
        real = F.filter(known, lambda e: (F.length(e["value"]) >= 4) & ~e["value"].rlike(r"^\d+$") & ~F.lower(e["value"]).isin(kept or [""]) & F.contains(t, e["value"]))
        each = F.transform(
            real,
            lambda e: F.struct(
                F.lit(1).alias("detector"), F.lit("known_value").alias("type"), F.lit("high").alias("severity"), e["value"].alias("value"), F.regexp_count(t, _edge(e["value"])).cast("long").alias("count"),
                F.concat(F.lit("Masked elsewhere as "), e["placeholder"], F.lit(", but visible here.")).alias("detail"),
            ),
        )
        parts.append(F.filter(each, lambda x: x["count"] > 0))
    terms = sorted({x.strip() for x in custom_terms if len(x.strip()) >= 3})
    if terms:
        each = _rows(F.array(*map(F.lit, terms)), 2, "custom_term", "high", lambda v: F.regexp_count(t, F.concat(F.lit("(?iu)"), _edge(v))), said("A term to mask is still visible."))
        parts.append(F.filter(each, lambda x: x["count"] > 0))
    if "network" in enabled:
        found = F.filter(all_of(IPV4), lambda v: ~v.startswith("127.") & (v != "0.0.0.0"))
        parts.append(_rows(_first(found), 3, "ip_address", "high", matches(found), said("An IPv4 address was not masked.")))
    if "identities" in enabled:
        found = all_of(MAILBOX)
        parts.append(_rows(_first(found), 4, "email", "high", matches(found), said("A mailbox was not masked.")))
    if "secrets" in enabled:
        found = all_of(HEX)
        parts.append(_rows(_first(found), 5, "secret_like", "medium", matches(found), said("A long hex run was not masked.")))
        odd = F.filter(F.array_distinct(all_of(TOKEN)), lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike("^(?:" + "|".join(CLASSES) + ")") & (entropy(v) >= ENTROPY))
        parts.append(_rows(_first(odd), 6, "secret_like", "medium", lambda v: _times(t, v), said("A token looks like a credential.")))
    if "network" in enabled:
        named = F.filter(all_of(ASSET), lambda v: v.rlike("[0-9]") & ~F.lower(v).isin([*SAFE, *kept]) & ~F.lower(v).rlike("^(?:" + "|".join(SAFE_PREFIXES) + ")"))
        parts.append(_rows(_first(named), 7, "host_like", "medium", lambda v: _times(t, v), said("A token looks like the name of an asset.")))

    def add(out: Column, f: Column) -> Column:
        fresh = (F.size(out) < MOST) & ~F.exists(out, lambda o: (o["type"] == f["type"]) & (F.lower(o["value"]) == F.lower(f["value"])))
        return F.when(fresh, F.array_append(out, f)).otherwise(out)

    kind = "array<struct<detector:int,type:string,severity:string,value:string,count:bigint,detail:string>>"
    if not parts:
        return F.array().cast(kind)
    merged = F.aggregate(F.concat(*[p.cast(kind) for p in parts]), F.array().cast(kind), add)
    # high before medium, then by kind, then as they came
    placed = F.transform(merged, lambda f, i: F.struct(f["severity"].alias("severity"), f["type"].alias("type"), i.alias("place"), f.alias("f")))
    return F.transform(F.array_sort(placed), lambda x: x["f"])


def scan(rows: DataFrame, mapping: DataFrame | None = None, custom_terms: list[str] = (), enabled: tuple[str, ...] = CATEGORIES, keep_terms: list[str] = (), id_col: str = "doc_id", text_col: str = "masked", mapping_col: str | None = None) -> DataFrame:
    """``<id_col>, rank, type, severity, value, count, detail`` of every text.

    Values that were masked come from a map column of the rows
    (``mapping_col``: no shuffle), or from ``mapping (<id_col>, placeholder,
    value, ord)``, gathered by text.
    """
    text = rows.select(F.col(id_col), F.col(text_col).alias("text"), *([F.col(mapping_col).alias("mapping")] if mapping_col else [])).where(F.trim("text") != "")
    known = None
    if mapping_col:
        known = F.transform(F.map_entries(F.coalesce("mapping", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("placeholder"), e["value"].alias("value")))
    elif mapping is not None:
        each = mapping.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ord", "placeholder", "value"))).alias("known"))
        text = text.join(each, id_col, "left")
        known = F.coalesce("known", F.array().cast("array<struct<ord:int,placeholder:string,value:string>>"))
    found = text.select(id_col, F.posexplode(findings(F.col("text"), known, custom_terms, enabled, keep_terms)).alias("rank", "f"))
    return found.select(id_col, (F.col("rank") + 1).alias("rank"), "f.type", "f.severity", "f.value", "f.count", "f.detail")


def blocking(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids with a finding of high severity."""
    return findings.where("severity = 'high'").select(id_col).distinct()
