"""Running per-key reward normalisation: in batch by a fold over earlier rows, in streams by keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECAY, WARMUP, EPSILON = 0.99, 8, 1e-6


def step(count: int, mean: float, square: float, value: float, decay: float = DECAY, warmup: int = WARMUP, epsilon: float = EPSILON) -> tuple[float, tuple[int, float, float]]:
    """(normalised value, next state): a value is normalised by what came before it, then taken in."""
    out = value if count < warmup else (value - mean) / math.sqrt(max(0.0, square - mean * mean) + epsilon)
    if count == 0:
        return out, (1, value, value * value)
    return out, (count + 1, decay * mean + (1 - decay) * value, decay * square + (1 - decay) * value * value)


#: Rows of a key that are normalised and given back at once.
CHUNK = 10_000


class _Held:
    """A key's rows of a micro-batch, sorted: 16 bytes each, and as many again while they are put in order."""

    def __init__(self, frames: Iterator[pd.DataFrame]):
        parts = [(frame["ord"].to_numpy(np.int64, copy=True), frame["value"].to_numpy(np.float64, copy=True)) for frame in frames]
        self.order, self.values = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        del parts
        at = np.argsort(self.order, kind="stable")
        self.order, self.values = self.order[at], self.values[at]

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(self.order), CHUNK):
            yield self.order[i : i + CHUNK], self.values[i : i + CHUNK]


def normalize_batch(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``normalized``, each key's rows in the order of ``order``. One shuffle by key; a key's rows are sorted by Spark and read as a stream of batches, never held whole."""
    slim = rows.select(F.col(key).cast("string").alias("key"), F.col(order).alias("ord"), F.col(value).cast("double").alias("value")).where("value is not null")
    spread = slim.repartition("key").sortWithinPartitions("key", "ord")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, (0, 0.0, 0.0)
        for frame in frames:
            normal = []
            for k, v in zip(frame["key"], frame["value"], strict=True):
                if k != now:
                    now, state = k, (0, 0.0, 0.0)
                score, state = step(*state, v)
                normal.append(score)
            yield frame.assign(normalized=normal)

    kind = dict(slim.dtypes)["ord"]
    return spread.mapInPandas(run, f"key string, ord {kind}, value double, normalized double")


def normalize_stream(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The same over a stream, with (count, mean, second moment) as each key's state; a micro-batch's rows of a key are taken in the order of ``order``."""
    slim = rows.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("ord"), F.col(value).cast("double").alias("value")).where("value is not null")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0.0, 0.0)
        for order, values in _Held(frames).chunks():
            normal = []
            for value in values.tolist():
                score, now = step(*now, value)
                normal.append(score)
            yield pd.DataFrame({"key": key[0], "ord": order, "value": values, "normalized": normal})
        state.update(now)

    return slim.groupBy("key").applyInPandasWithState(run, "key string, ord long, value double, normalized double", "n long, mean double, square double", "append", GroupStateTimeout.NoTimeout)
