"""Scopes of a reduction and a recipe for evolution steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.functions.reductions import reduction

#: Grouping columns by scope; the weight differs as well, so these aren't grouping sets.
SCOPES = {"global": [], "level": ["rl"], "map": ["rl", "map"], "local": ["rl", "map", "c"]}


def reduce_scope(df: DataFrame, scope: str, names: list[str], x: str, w: str | None, dim: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reductions by scope: volumes count only over several levels, weights only above single maps."""
    if scope not in SCOPES:
        raise ValueError(f"no reduction in scope {scope}")
    level = F.col("rl") if scope == "global" else None
    weight = w if scope in ("global", "level") else None
    out = [reduction(n, x, weight, level, dim).alias(n) for n in names]
    by = [*keys, *SCOPES[scope]]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def evolve(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], iterations: int, levels: int, factor: int = 2, every: int = 4, after: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Evolution recipe: in each iteration the due levels step, coarse to fine; lineage is cut now and then.

    step(rows of one level, iteration) returns that level's new rows; `after` (for
    example restriction) sees the whole state when all due levels have stepped.
    """
    for it in range(1, iterations + 1):
        for rl in range(levels):
            if (it - 1) % factor ** (levels - 1 - rl) == 0:
                state = state.where(F.col("rl") != rl).unionByName(step(state.where(F.col("rl") == rl), it))
        if after is not None:
            state = after(state, it)
        if it % every == 0:
            if not state.sparkSession.sparkContext.getCheckpointDir():
                raise ValueError("set a checkpoint folder, where the lineage of the state is cut")
            state = state.checkpoint()
    return state
