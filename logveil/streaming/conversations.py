"""Masking of conversations turn by turn: a placeholder keeps its value through a conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernel
from ..operators.kernel import MaskConfig

TURN = "conv_id long, turn long, role string, masked string, mapping_size long"


def batch(turns: DataFrame, config: MaskConfig | None = None) -> DataFrame:
    """Every conversation in the order of its turns; one conversation is one group, as its mapping passes from turn to turn."""
    config = config or MaskConfig()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("turn", "ascending"), ("role", "ascending")])
        session = kernel.Session(config)
        masked, sizes = [], []
        for text in group.column("text").to_pylist():
            masked.append(session.mask(text or "")[0])
            sizes.append(len(config.base_mapping) + len(session.learned))
        return pa.table([group.column("conv_id"), group.column("turn"), group.column("role"), pa.array(masked), pa.array(sizes, pa.int64())], names=["conv_id", "turn", "role", "masked", "mapping_size"])

    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInArrow(run, TURN)


def stream(turns: DataFrame, config: MaskConfig | None = None) -> DataFrame:
    """The same over a stream of turns, which must arrive in order; the mapping is keyed state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    config = config or MaskConfig()

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        session = kernel.Session(config, dict(zip(*state.get, strict=True)) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(["turn", "role"], kind="stable")
        out = []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"], strict=True):
            masked, _ = session.mask(text or "")
            out.append((key[0], turn, role, masked, len(config.base_mapping) + len(session.learned)))
        state.update((list(session.learned), list(session.learned.values())))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "masked", "mapping_size"])

    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").applyInPandasWithState(step, TURN, "placeholders array<string>, vals array<string>", "append", GroupStateTimeout.NoTimeout)
