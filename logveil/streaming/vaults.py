"""Vaults as a stream: incidents of many vaults, each with one mapping that grows and survives restarts.

The state of a vault is its map from value to placeholder, the highest number
of each label, and an index from a word to the values that have it, so an
incident looks up its own words and not the whole vault. All of it lies in the
state store and goes on after a restart where the checkpoint was; with an idle
time, what no incident has written for so long is forgotten by the store; a
query with an idle time goes on until it is stopped, as time may pass without
incidents, so it needs a trigger other than ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import kernel, vaulting
from ..operators.kernel import MaskConfig

MASKED = "vault string, incident_id string, ord long, masked string, n_values long, late boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Vault(StatefulProcessor):
    """One vault's incidents in the order of ``ord`` within a batch; what comes after a later one is masked as it arrives, and marked ``late``."""

    def __init__(self, config: MaskConfig, idle_ms: int | None = None):
        self.config, self.idle = config, idle_ms

    def init(self, handle) -> None:
        # value -> placeholder, label, its number in the order in which values became known
        self.given = handle.getMapState("given", "value string", "placeholder string, label string, at long", self.idle)
        self.words = handle.getMapState("words", "word string", "vals array<string>", self.idle)
        self.tops = handle.getMapState("tops", "label string", "n long", self.idle)
        self.last = handle.getValueState("last", "ord long, known long", self.idle)

    def _offers(self, text: str) -> dict[str, str]:
        """Known values that may stand in the text, in the order in which they became known."""
        values = {v for w in vaulting.words_of(text) if self.words.containsKey((w,)) for v in self.words.getValue((w,))[0]}
        found = sorted((self.given.getValue((v,)) + (v,) for v in values if self.given.containsKey((v,))), key=lambda x: x[2])
        return {f"[{label}_{k}]": v for k, (_, label, _, v) in enumerate(found)}

    def _placeholder(self, label: str, value: str, known: int) -> tuple[str, bool]:
        config = self.config.numbering
        if self.given.containsKey((value,)):
            return self.given.getValue((value,))[0], False
        out = config.exact.get((label, value)) or config.any_label.get(value)
        if out is not None:
            return out, False
        top = max(self.tops.getValue((label,))[0] if self.tops.containsKey((label,)) else 0, config.top.get(label, 0)) + 1
        out = f"[{label}_{top}]"
        self.tops.updateValue((label,), (top,))
        self.given.updateValue((value,), (out, label, known))
        word = max(vaulting.keys_of(value), key=len, default=None)
        if word is not None:
            held = list(self.words.getValue((word,))[0]) if self.words.containsKey((word,)) else []
            self.words.updateValue((word,), ([*held, value],))
        return out, True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        order, known = self.last.get() if self.last.exists() else (None, 0)
        batch = pd.concat(list(rows)).sort_values(["ord", "incident_id"], kind="stable")
        out = []
        for incident, at, text in zip(batch["incident_id"], batch["ord"], batch["text"], strict=True):
            late = order is not None and at < order
            order = at if order is None else max(order, at)
            offers = self._offers(text)
            spans = kernel.detect(text, self.config, self.config.known.extended(offers) if offers else None)
            label_of, name = kernel.labelled(spans), {}
            for s in sorted(spans, key=lambda s: s.start, reverse=True):
                if s.value not in name:
                    name[s.value], new = self._placeholder(label_of[s.value], s.value, known)
                    known += new
            pieces, end = [], 0
            for s in sorted(spans, key=lambda s: s.start):
                pieces += (text[end : s.start], name[s.value])
                end = s.end
            out.append((key[0], incident, at, "".join([*pieces, text[end:]]), known, late))
        self.last.update((int(order), int(known)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MASKED.split(", ")])

    def close(self) -> None:
        pass


def masked(incidents: DataFrame, config: MaskConfig | None = None, idle_ms: int | None = None) -> DataFrame:
    """``MASKED`` of a stream of ``incidents (vault, incident_id, ord, text)``; ``n_values`` is what the vault has learnt by then.

    Null texts are empty; rows without a vault are one vault, rows without an
    ``ord`` come first. One vault is one key, so vaults are what runs in
    parallel; the mapping of one vault over a whole table is a batch job (see
    ``operators.vaulting``).
    """
    spark = incidents.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # map states need it
    rows = incidents.select(
        F.coalesce(F.col("vault").cast("string"), F.lit("")).alias("vault"), F.coalesce(F.col("incident_id").cast("string"), F.lit("")).alias("incident_id"),
        F.coalesce(F.col("ord").cast("long"), F.lit(-(1 << 63))).alias("ord"), F.coalesce("text", F.lit("")).alias("text"),
    )
    idle = {} if idle_ms is None else {"timeMode": "ProcessingTime"}
    return rows.groupBy("vault").transformWithStateInPandas(statefulProcessor=Vault(config or MaskConfig(), idle_ms), outputStructType=MASKED, outputMode="append", **({"timeMode": "none"} | idle))
