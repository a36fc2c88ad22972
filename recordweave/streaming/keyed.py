"""Streaming forms of the keyed state: what was seen, counters and streaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(stream: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """The first row of each key; state is dropped once the watermark is past it by `within`."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def counters(stream: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Rows (n) and sums of the counts of each key, for update or complete mode."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in counts))


def growth(stream: DataFrame, key: str, pos: str, found: str, limit: int = 3) -> DataFrame:
    """key, level, streak after each batch: `limit` fruitless rows in a row, by pos within the batch, raise the level and start the streak anew.

    A batch's rows of one key are sorted in its task; a key's state is two numbers.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, streak = state.get if state.exists else (0, 0)
        for hit in pd.concat(parts).sort_values(pos)[found].gt(0):
            streak = 0 if hit else streak + 1
            if streak == limit:
                level, streak = level + 1, 0
        state.update((level, streak))
        yield pd.DataFrame({key: [k[0]], "level": [level], "streak": [streak]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, pos, found).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, level long, streak long", "level long, streak long", "update", GroupStateTimeout.NoTimeout)
