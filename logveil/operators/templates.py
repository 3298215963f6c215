"""Analysis templates ranked by the signals that fire in a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.registry import JsonStore
from ..rules.template_values import SIGNALS, TEMPLATES
from . import kernel
from .masking import dealt

LEAST, MOST = 0.12, 3
FIELDS = ("template_id", "name", "category", "tactic", "tactic_id", "technique", "technique_id")
EDITABLE = FIELDS[1:] + ("prompt",)


def default_prompt(name: str, tactic: str, technique: str, technique_id: str) -> str:
    """What a built-in template asks, in this package's own words."""
    about = f"{technique} ({technique_id})" if technique_id else technique
    return (
        f"Read the masked log as an analyst who looks for {name.lower()}. Say what supports and what speaks against {about} under {tactic}, "
        "with the lines that show it and their times; name the accounts, hosts and addresses concerned by their placeholders; "
        "say how sure you are, what else could explain it, and what to check and do next."
    )


def library(spark: SparkSession, overrides: dict[str, dict] | None = None, custom: list[dict] = ()) -> DataFrame:
    """``ord``, the fields, ``prompt``, ``mitre``, ``custom``, ``modified`` and ``keywords`` of all templates, with edits applied."""
    rows = []
    for values in TEMPLATES:
        t = dict(zip(FIELDS, values, strict=True))
        t["prompt"] = default_prompt(t["name"], t["tactic"], t["technique"], t["technique_id"])
        edits = {k: v for k, v in (overrides or {}).get(t["template_id"], {}).items() if k in EDITABLE}
        t |= edits
        rows.append((len(rows), *(t[f] for f in FIELDS), t["prompt"], _mitre(t), False, bool(edits), []))
    for c in custom:
        if c.get("template_id") and c.get("name"):
            rows.append((len(rows), *(c.get(f, "") for f in FIELDS), c.get("prompt", ""), _mitre(c), True, False, [k for k in c.get("keywords", []) if k]))
    return spark.createDataFrame(rows, "ord int, " + ", ".join(f"{f} string" for f in FIELDS) + ", prompt string, mitre string, custom boolean, modified boolean, keywords array<string>")


def _mitre(t: dict) -> str:
    return f"{t.get('tactic', '')} ({t.get('tactic_id', '')}) \u00b7 {t.get('technique', '')} {t.get('technique_id', '')}"


class TemplateStore:
    """Edits of built-in templates and a user's own, in one file."""

    def __init__(self, path: str):
        self._file = JsonStore(path, {})

    def overrides(self) -> dict[str, dict]:
        return self._file.load().get("overrides", {})

    def custom(self) -> list[dict]:
        return self._file.load().get("custom", [])

    def _save(self, overrides: dict[str, dict], custom: list[dict]) -> None:
        self._file.save({"overrides": {k: v for k, v in overrides.items() if v}, "custom": custom})

    @staticmethod
    def _cleaned(fields: dict) -> dict:
        out = {k: str(fields[k]).strip() for k in EDITABLE if fields.get(k) is not None}
        for k in ("name", "prompt"):
            if out.get(k) == "":
                raise ValueError(f"A template's {k} can't be empty.")
        if isinstance(fields.get("keywords"), list):
            out["keywords"] = [w for w in (str(k).strip() for k in fields["keywords"]) if w]
        return out

    def library(self, spark: SparkSession) -> DataFrame:
        return library(spark, self.overrides(), self.custom())

    def save(self, template_id: str, fields: dict) -> None:
        """Edits a template; what equals a built-in's default is no edit."""
        new, own = self._cleaned(fields), self.custom()
        if template_id in SIGNALS:
            t = dict(zip(FIELDS, next(v for v in TEMPLATES if v[0] == template_id), strict=True))
            t["prompt"] = default_prompt(t["name"], t["tactic"], t["technique"], t["technique_id"])
            edits = self.overrides().get(template_id, {}) | {k: v for k, v in new.items() if k != "keywords"}
            self._save(self.overrides() | {template_id: {k: v for k, v in edits.items() if v != t[k]}}, own)
        elif any(c["template_id"] == template_id for c in own):
            self._save(self.overrides(), [c | new if c["template_id"] == template_id else c for c in own])
        else:
            raise ValueError(f"There is no template {template_id}.")

    def create(self, fields: dict) -> str:
        """A new template from its name and prompt; returns its id."""
        new = self._cleaned(fields)
        if not {"name", "prompt"} <= new.keys():
            raise ValueError("A new template needs a name and a prompt.")
        template_id = slug(new["name"], {*SIGNALS, *(c["template_id"] for c in self.custom())})
        blank = dict.fromkeys(FIELDS, "") | {"category": "Custom", "tactic": "Custom", "keywords": []}
        self._save(self.overrides(), [*self.custom(), blank | new | {"template_id": template_id}])
        return template_id

    def delete(self, template_id: str) -> None:
        left = [c for c in self.custom() if c["template_id"] != template_id]
        if len(left) == len(self.custom()):
            raise ValueError("A built-in template can be reset, not deleted." if template_id in SIGNALS else f"There is no template {template_id}.")
        self._save(self.overrides(), left)

    def reset(self, template_id: str) -> None:
        if template_id not in SIGNALS:
            raise ValueError("Only built-in templates can be reset.")
        self._save({k: v for k, v in self.overrides().items() if k != template_id}, self.custom())


def signals(custom: list[dict] = ()) -> list[tuple[str, int, str]]:
    """``(template id, weight, pattern)``; a keyword of a custom template is itself, of weight 2."""
    out = [(t, w, p) for t, each in SIGNALS.items() for w, p in each]
    return out + [(c["template_id"], 2, re.escape(k.strip())) for c in custom for k in c.get("keywords", []) if k and k.strip()]


@lru_cache(8)
def _patterns(custom: tuple[tuple[str, int, str], ...]) -> list[tuple[str, list[tuple[int, kernel.Pattern]], int]]:
    by: dict[str, list[tuple[int, str]]] = {}
    for t, w, p in custom:
        by.setdefault(t, []).append((w, p))
    return [(t, [(w, kernel.Pattern("(?i)" + p)) for w, p in own], sum(w for w, _ in own)) for t, own in by.items()]


def ranked(text: str, known: tuple[tuple[str, int, str], ...], most: int = MOST, least: float = LEAST) -> list[tuple[int, str, float, int]]:
    """``rank, template id, score, signals that fired`` of the best templates for one text."""
    views, found = kernel.Views(text), []
    for order, (template, own, total) in enumerate(_patterns(known)):
        fired = [w for w, p in own if views.may_match(p.needs) and p.regex.search(text)]
        if fired and sum(fired) / total >= least:
            found.append((-sum(fired) / total, -len(fired), order, template))
    return [(k, template, round(-score, 3), -n) for k, (score, n, _, template) in enumerate(sorted(found)[:most], 1)]


def suggest(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, least: float = LEAST, custom: list[dict] = ()) -> DataFrame:
    """``<id_col>, rank, template_id, score, signals_fired``: at most ``most`` templates of a text whose score is ``least`` or more.

    One pass over Arrow batches without a shuffle: a look for the strings that a
    signal needs spares most texts its pattern. Texts that are null or blank
    have no rows.
    """
    known = tuple(signals(list(custom)))
    kinds = [pa.int32(), pa.string(), pa.float64(), pa.int32()]
    names = [id_col, "rank", "template_id", "score", "signals_fired"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [ranked(t, known, most, least) if t and t.strip() else [] for t in batch.column(1).to_pylist()]
            where = pa.array([i for i, r in enumerate(each) for _ in r], pa.int32())
            columns = [pa.array([x[k] for r in each for x in r], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), *columns], names)

    kind = rows.schema[id_col].dataType.simpleString()
    return dealt(rows.select(id_col, F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, rank int, template_id string, score double, signals_fired int")


def search(templates: DataFrame, query: str) -> DataFrame:
    """Templates that have every word of the query."""
    text = F.lower(F.concat_ws(" ", *FIELDS[1:]))
    for word in query.lower().split():
        templates = templates.where(F.contains(text, F.lit(word)))
    return templates


def slug(name: str, taken: set[str]) -> str:
    """An id for a new template, with ``_2`` and so on where it is taken."""
    base = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "template"
    n, out = 1, base
    while out in taken:
        n += 1
        out = f"{base}_{n}"
    return out
