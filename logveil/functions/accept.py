"""Which detected values are vetoed: a Column expression, and the same for the kernel."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import values as V

NAMED = ("USER", "DOMAIN", "HOST", "ASSET", "ORG", "GROUP", "SUBJECT")
CONTAINERS = ("ASSET", "ORG", "GROUP", "SUBJECT")
MACHINES = ("USER", "DOMAIN", "HOST")

_SYNTAX, _SECRET_SYNTAX = re.compile(V.PS_NOT_A_VALUE), re.compile(V.PS_NOT_A_SECRET)
_SID, _FILE = re.compile(V.SHORT_SID), re.compile(V.PATH_FILE)
_BUILTIN, _SAAS, _PREFIXES = frozenset(V.BUILTIN_VALUES), frozenset(V.SAAS_APPS), frozenset(V.BUILTIN_PREFIXES)
_DOMAINS, _HOSTS, _EXTENSIONS = frozenset(V.DOMAIN_ALLOWLIST), frozenset(V.NOT_HOSTS), frozenset(V.NOT_TLDS)
_PATHS, _VERBS = frozenset(V.PATH_WORDS), frozenset(V.PS_VERBS)


def luhn(digits: str) -> bool:
    doubled = str.maketrans("0123456789", "0246813579")
    own, other = digits[-1::-2], digits[-2::-2].translate(doubled)
    return (sum(map(int, own)) + sum(map(int, other))) % 10 == 0


def _local(address: str) -> bool:
    try:
        ip = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return False
    return ip.is_loopback or ip.is_unspecified


def _account(value: str) -> str | None:
    """Of DOMAIN\\account: the rule against it."""
    domain, account = value.lower().split("\\", 1)
    if domain in _PREFIXES or domain in _DOMAINS:
        return "R10"
    if account.strip("\\") in _BUILTIN:
        return "R11"
    if domain.rsplit(" ", 1)[-1] in _PATHS or account.split("\\", 1)[0] in _PATHS or _FILE.search(account):
        return "R12"
    return None


def _host(value: str) -> str | None:
    low = value.lower()
    if low in _DOMAINS or low in _HOSTS:
        return "R14"
    if value.isdigit():
        return "R15"
    if "." not in value:
        return None
    last = value.rsplit(".", 1)[1]
    if last.lower() in _EXTENSIONS:
        return "R16"
    if any(map(str.isupper, last[1:])) and any(map(str.islower, last)):
        return "R17"
    return None


def veto(label: str, value: str) -> str | None:
    """The first rule (R1 to R20) that throws the value out, or None."""
    v = value.strip()
    if not v:
        return "R1"
    if label == "SECRET":
        if _SECRET_SYNTAX.match(v):
            return "R3"
        if "-" in v and v.lstrip("([{").split("-", 1)[0].lower() in _VERBS:
            return "R4"
        return "R19" if v[0] == "/" else None
    if _SYNTAX.match(v):
        return "R2"
    if label in NAMED:
        low = v.lower()
        if low in _BUILTIN:
            return "R5"
        if label in CONTAINERS:
            if label in ("ASSET", "ORG") and low in _SAAS:
                return "R6"
            return "R7" if len(v) < 3 else None
        if v[0] == "\\":
            return "R8"
        if _SID.fullmatch(v):
            return "R9"
        if label == "USER" and "\\" in v and (why := _account(v)):
            return why
        if label != "HOST":
            return "R13" if v.isdigit() else None
        return _host(v)
    if label in ("IP", "IPV6"):
        return "R18" if _local(v) else None
    if label == "CC":
        digits = v.replace(" ", "").replace("-", "")
        return None if 13 <= len(digits) <= 16 and luhn(digits) else "R20"
    return None


REASONS = {
    "R1": "It is empty.", "R2": "PowerShell syntax stands where a value would.", "R3": "PowerShell syntax stands where a secret would.", "R4": "It is a PowerShell command.",
    "R5": "It is a built-in account or a placeholder.", "R6": "It names a vendor's product.", "R7": "It has fewer than three characters.", "R8": "It begins with a backslash.",
    "R9": "It is a well-known SID.", "R10": "Its domain is built in.", "R11": "Its account is built in.", "R12": "It is part of a path.", "R13": "It is a number.",
    "R14": "It is an allowed domain or no host.", "R15": "It is a number.", "R16": "It ends like a file or a unit.", "R17": "It ends in camel case, like a type.",
    "R18": "It is a loopback or unspecified address.", "R19": "It is a path.", "R20": "Its digits are no card number.",
}


def accepted(label: str, value: str) -> bool:
    return veto(label, value) is None


def veto_column(label: Column, value: Column) -> Column:
    """:func:`veto` in Catalyst, for ASCII digits and canonical addresses."""
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    low = F.lower(v)
    named, boxes, machines = label.isin(*NAMED), label.isin(*CONTAINERS), label.isin(*MACHINES)
    last = F.element_at(F.split(v, r"\.", -1), -1)
    domain, account = F.substring_index(low, "\\", 1), F.regexp_replace(low, r"^[^\\]*\\", "")
    halves = (label == "USER") & F.contains(v, F.lit("\\"))
    digits = F.regexp_replace(v, "[ -]", "")
    secret = label == "SECRET"
    checks = [
        ("R1", v == ""),
        ("R3", secret & v.rlike(V.PS_NOT_A_SECRET)),
        ("R2", ~secret & v.rlike(V.PS_NOT_A_VALUE)),
        ("R4", secret & F.contains(v, F.lit("-")) & F.lower(F.substring_index(F.regexp_replace(v, r"^[(\[{]+", ""), "-", 1)).isin(*V.PS_VERBS)),
        ("R5", named & low.isin(*V.BUILTIN_VALUES)),
        ("R6", label.isin("ASSET", "ORG") & low.isin(*V.SAAS_APPS)),
        ("R7", boxes & (F.length(v) < 3)),
        ("R8", machines & v.startswith("\\")),
        ("R9", machines & v.rlike(r"^(?i:S-1-\d+(?:-\d+){0,3})$")),
        ("R10", halves & (domain.isin(*V.BUILTIN_PREFIXES) | domain.isin(*V.DOMAIN_ALLOWLIST))),
        ("R11", halves & F.regexp_replace(account, r"^\\+|\\+$", "").isin(*V.BUILTIN_VALUES)),
        ("R12", halves & (F.substring_index(domain, " ", -1).isin(*V.PATH_WORDS) | F.substring_index(account, "\\", 1).isin(*V.PATH_WORDS) | account.rlike(V.PATH_FILE))),
        ("R13", label.isin("USER", "DOMAIN") & v.rlike(r"^\d+$")),
        ("R14", (label == "HOST") & (low.isin(*V.DOMAIN_ALLOWLIST) | low.isin(*V.NOT_HOSTS))),
        ("R15", (label == "HOST") & v.rlike(r"^\d+$")),
        ("R16", (label == "HOST") & F.contains(v, F.lit(".")) & F.lower(last).isin(*V.NOT_TLDS)),
        ("R17", (label == "HOST") & F.contains(v, F.lit(".")) & last.rlike(r"^.+[A-Z]") & last.rlike("[a-z]")),
        ("R18", label.isin("IP", "IPV6") & v.rlike(r"^\[*(?:127\.\d+\.\d+\.\d+|0\.0\.0\.0|::1|::|0*(?::0*){6}:0*1?)\]*$")),
        ("R19", secret & v.startswith("/")),
        ("R20", (label == "CC") & ~(F.length(digits).between(13, 16) & F.call_function("luhn_check", digits))),
    ]
    out = F.lit(None).cast("string")
    for name, check in reversed(checks):
        out = F.when(check, F.lit(name)).otherwise(out)
    return out
