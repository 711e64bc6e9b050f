"""Stream-like behaviour with Structured Streaming: output cadence, bounded history, live reductions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattika.functions.reductions import reduction


def live_reduction(stream: DataFrame, time: str, delay: str, window: str, x: str, w: str, names: list[str]) -> DataFrame:
    """Weighted reductions of windows of an event-time stream, late rows dropped after the delay."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window)).agg(*[reduction(n, x, w).alias(n) for n in names])


def cadence(stream: DataFrame, key: str, at: str, step: float) -> DataFrame:
    """Rows at which output is due for a key: the first, then each at least `step` after the last one (seconds or iterations)."""
    kind = dict(stream.dtypes)[key]

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        values = sorted(v for f in frames for v in f[at])
        out = []
        for v in values:
            if last is None or v >= last + step - 1e-12:
                out.append(v)
                last = v
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame({key: [k[0]] * len(out), at: out})

    rows = stream.select(key, F.col(at).cast("double").alias(at))
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {at} double", "last double", "append", GroupStateTimeout.NoTimeout)


def history(stream: DataFrame, key: str, at: str, value: str, levels: int) -> DataFrame:
    """The newest `levels` values of each key after each batch (a ring buffer as state)."""
    kind = dict(stream.dtypes)[key]

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = list(zip(*state.get, strict=True)) if state.exists else []
        new = [(float(a), float(v)) for f in frames for a, v in zip(f[at], f[value], strict=True)]
        kept = sorted([*old, *new], reverse=True)[:levels]
        state.update(([a for a, _ in kept], [v for _, v in kept]))
        yield pd.DataFrame({key: [k[0]] * len(kept), "tl": range(len(kept)), at: [a for a, _ in kept], value: [v for _, v in kept]})

    rows = stream.select(key, F.col(at).cast("double").alias(at), F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, tl int, {at} double, {value} double", "a array<double>, v array<double>", "update", GroupStateTimeout.NoTimeout)
