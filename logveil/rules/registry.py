"""Rules as rows: the built-in catalogue, overrides, user patterns and their validation."""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
import threading
from dataclasses import dataclass
from functools import lru_cache
from multiprocessing.connection import wait
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import values

CATEGORIES = ("identities", "network", "secrets")
LABEL_RANK = {label: rank for rank, label in enumerate(values.LABELS)}
NO_RANK = 99
MAX_PATTERN, PATTERN_SECONDS = 500, 2.0


@dataclass(frozen=True)
class Rule:
    priority: int
    rule_id: str
    source: str
    note: str
    category: str
    label: str
    regex: str
    default_regex: str

    @property
    def modified(self) -> bool:
        return self.regex != self.default_regex


@lru_cache(1)
def defaults() -> tuple[Rule, ...]:
    return tuple(Rule(i, rid, source, values.NOTES[rid], category, label, regex, regex) for i, (rid, source, label, category, regex) in enumerate(values.RULES))


def compiles(regex: str) -> bool:
    try:
        re.compile(regex)
    except (re.error, RecursionError, OverflowError):
        return False
    return True


def effective(overrides: dict[str, str] | None = None) -> list[Rule]:
    """The catalogue in claim order; an override that doesn't compile leaves its rule as it is."""
    changed = {k: v for k, v in (overrides or {}).items() if v and compiles(v)}
    if not changed:
        return list(defaults())
    return [Rule(**(r.__dict__ | {"regex": changed.get(r.rule_id, r.regex)})) for r in defaults()]


def catalogue(spark: SparkSession, overrides: dict[str, str] | None = None) -> DataFrame:
    """One row for each rule: ``priority, rule_id, source, note, category, label, regex, default_regex, modified``."""
    schema = "priority int, rule_id string, source string, note string, category string, label string, regex string, default_regex string, modified boolean"
    return spark.createDataFrame([(*r.__dict__.values(), r.modified) for r in effective(overrides)], schema)


def search_catalogue(rules: DataFrame, query: str) -> DataFrame:
    """Rules by text: a hit on a source keeps all of its rules, else those hit themselves; sources A to Z, claim order inside."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    needle = F.lit(query.strip().lower())
    own = F.greatest(*[F.lower(c).contains(needle).cast("int") for c in ("rule_id", "note", "label", "regex")])
    of_source = F.max(F.lower("source").contains(needle).cast("int")).over(Window.partitionBy("source"))
    return rules.withColumn("hit", F.greatest(own, of_source)).where("hit = 1").drop("hit").orderBy(F.lower("source"), "priority")


def clean_label(label: str) -> str:
    """A user's label in the alphabet of placeholders; ``CUSTOM`` where nothing is left."""
    return re.sub(r"[^A-Z0-9]", "", label.upper()) or "CUSTOM"


def _probes(regex: str) -> list[str]:
    """Short inputs that a pattern almost matches: long runs of its own characters, and a few general shapes."""
    own = list(dict.fromkeys(c for c in regex if c.isalnum()))[:6]
    runs = [c * 40 + "!" for c in own]
    if len(own) > 1:
        runs.append("".join(own) * 12 + "!")
    return [*runs, "a" * 42 + "!", "0123456789" * 6 + "@", "ab" * 24 + ";", " " * 40 + "!", "2026-01-05 10:14:02 user=pkim from 10.1.2.3 host=srv01.corp.lan"]


class _Trials:
    """A process that tries one pattern after the other on its probes: killed where one takes too long, and started again for the next."""

    PROGRAM = """
import json, re, sys
print(flush=True)
for line in sys.stdin:
    regex, *probes = json.loads(line)
    try:
        p = re.compile(regex)
        for s in probes:
            p.search(s)
        print(1, flush=True)
    except Exception:
        print(0, flush=True)
"""

    def __init__(self):
        self.process: subprocess.Popen | None = None
        self.owner = 0  # a fork of this process starts its own
        self.lock = threading.Lock()

    def _answer(self, seconds: float | None) -> bytes:
        """The next line, nothing where the process has ended; TimeoutError where none comes in time."""
        if not wait([self.process.stdout], seconds):
            raise TimeoutError
        return self.process.stdout.readline()

    def _stop(self) -> None:
        done, self.process = self.process, None
        done.kill()
        done.communicate()

    def run(self, regex: str) -> bool:
        """Whether the pattern works; TimeoutError where it is slower than two seconds."""
        with self.lock:
            if self.process is None or self.owner != os.getpid() or self.process.poll() is not None:
                self.process = subprocess.Popen([sys.executable, "-c", self.PROGRAM], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=0)
                self.owner = os.getpid()
                self._answer(None)  # it runs
            try:
                self.process.stdin.write(json.dumps([regex, *_probes(regex)]).encode() + b"\n")
                answer = self._answer(PATTERN_SECONDS)
            except TimeoutError:
                self._stop()
                raise
            except BrokenPipeError:
                answer = b""
            if not answer:
                self._stop()
            return answer == b"1\n"


_TRIALS = _Trials()


@lru_cache(4096)
def validate(regex: str | None) -> str:
    """The trimmed pattern, or ValueError: empty, longer than 500, not a pattern, or slower than two seconds on its probes (tried in a process that can be killed)."""
    regex = (regex or "").strip()
    if not regex:
        raise ValueError("The pattern is empty.")
    if len(regex) > MAX_PATTERN:
        raise ValueError(f"The pattern has {len(regex)} characters; {MAX_PATTERN} are allowed.")
    if not compiles(regex):
        raise ValueError("Not a regular expression.")
    try:
        works = _TRIALS.run(regex)
    except TimeoutError:
        raise ValueError("The pattern backtracks without end on short inputs.") from None
    if not works:
        raise ValueError("Not a regular expression.")
    return regex


class JsonStore:
    """A small JSON file; a missing or broken one reads as ``empty``."""

    def __init__(self, path: str | Path, empty):
        self.path, self.empty = Path(path), empty

    def load(self):
        try:
            data = json.loads(self.path.read_text("utf-8"))
        except (OSError, ValueError):
            return self.empty
        return data if isinstance(data, type(self.empty)) else self.empty

    def save(self, data) -> None:
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps(data, indent=2, ensure_ascii=False), "utf-8")
        new.replace(self.path)


class RuleStore:
    """Overrides of built-in rules and saved patterns, in files of ``folder``."""

    def __init__(self, folder: str | Path):
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        self._overrides = JsonStore(folder / "builtin_overrides.json", {})
        self._patterns = JsonStore(folder / "custom_patterns.json", [])
        self._terms = JsonStore(folder / "custom_terms.json", [])
        self._keep = JsonStore(folder / "keep_terms.json", [])

    def migrate(self, workspaces: str | Path | None = None) -> bool:
        """Fills an empty store from the terms and patterns of an older file of workspaces: its active one, else the default, else the first. True where something came."""
        if workspaces is None or self._terms.load() or self._patterns.load():
            return False
        told = JsonStore(workspaces, {}).load()
        spaces = told.get("workspaces") if isinstance(told.get("workspaces"), dict) else {}
        chosen = next((w for w in (spaces.get(told.get("active")), spaces.get("default"), *spaces.values()) if isinstance(w, dict)), {})
        terms = [t for t in chosen.get("custom_terms", []) if isinstance(t, str)]
        patterns = [{"label": p["label"], "regex": p["regex"]} for p in chosen.get("custom_patterns", []) if isinstance(p, dict) and p.get("label") and p.get("regex")]
        if terms:
            self._terms.save(distinct_terms(terms))
        if patterns:
            self._patterns.save(patterns)
        return bool(terms or patterns)

    def overrides(self) -> dict[str, str]:
        return {k: v for k, v in self._overrides.load().items() if isinstance(v, str) and v}

    def set_override(self, rule_id: str, regex: str) -> None:
        """A pattern equal to the default removes the override."""
        regex = validate(regex)
        known = {r.rule_id: r.regex for r in defaults()}
        if rule_id not in known:
            raise ValueError(f"No such rule: {rule_id}")
        left = {k: v for k, v in self.overrides().items() if k != rule_id}
        self._overrides.save(left if regex == known[rule_id] else left | {rule_id: regex})

    def reset_override(self, rule_id: str) -> None:
        self._overrides.save({k: v for k, v in self.overrides().items() if k != rule_id})

    def patterns(self) -> list[dict[str, str]]:
        return [p for p in self._patterns.load() if isinstance(p, dict) and p.get("regex") and p.get("label")]

    def add_pattern(self, label: str, regex: str) -> dict[str, str]:
        regex = validate(regex)
        saved = self.patterns()
        if any(p["regex"] == regex for p in saved):
            raise ValueError("That pattern is saved already.")
        new = {"label": clean_label(label), "regex": regex}
        self._patterns.save([*saved, new])
        return new

    def delete_pattern(self, regex: str) -> None:
        self._patterns.save([p for p in self.patterns() if p["regex"] != regex])

    def terms(self) -> list[str]:
        return distinct_terms(t for t in self._terms.load() if isinstance(t, str))

    def save_terms(self, terms: list[str]) -> list[str]:
        """Terms always masked; each stops being one that is kept."""
        terms = distinct_terms(terms)
        self._terms.save(terms)
        mine = {t.lower() for t in terms}
        self._keep.save([t for t in self.keep_terms() if t.lower() not in mine])
        return terms

    def keep_terms(self) -> list[str]:
        return distinct_terms(t for t in self._keep.load() if isinstance(t, str))

    def add_keep_term(self, term: str) -> list[str]:
        """Two characters at least; a term that is always masked can't be kept."""
        term = term.strip()
        if len(term) < 2:
            raise ValueError("A kept term needs two characters at least.")
        if term.lower() in {t.lower() for t in self.terms()}:
            raise ValueError("That term is always masked.")
        kept = distinct_terms([*self.keep_terms(), term])
        self._keep.save(kept)
        return kept

    def delete_keep_term(self, term: str) -> None:
        self._keep.save([t for t in self.keep_terms() if t.lower() != term.strip().lower()])


def distinct_terms(terms) -> list[str]:
    """Trimmed, without blanks, the first spelling of those that differ only in case."""
    first: dict[str, str] = {}
    for t in terms:
        if t := t.strip():
            first.setdefault(t.lower(), t)
    return list(first.values())


def split_terms(text: str) -> list[str]:
    """Terms as typed: parted by newlines or commas."""
    return [t.strip() for t in re.split(r"[\n,]", text) if t.strip()]


def terms_of(text: Column) -> Column:
    """``distinct_terms(split_terms(text))`` as an array, by Catalyst: the first spelling of terms that differ only in case."""
    each = F.filter(F.transform(F.split(text, r"[\n,]"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
    return F.filter(each, lambda t, i: ~F.exists(F.slice(each, 1, i), lambda before: F.lower(before) == F.lower(t)))
