"""Hyperslabs and slices: filter, stride and reindex."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slab:
    """Origin, directions (one index vector for each output axis), strides and lengths."""

    origin: tuple[int, ...]
    directions: tuple[tuple[int, ...], ...]
    stride: tuple[int, ...]
    length: tuple[int, ...]


def hyperslab(df: DataFrame, axes: list[str], slab: Slab, value: str = "v", names: list[str] | None = None) -> DataFrame:
    """All points of the slab with output indices from 0; points that df lacks are 0."""
    spark = df.sparkSession
    names = names or [f"s{k}" for k in range(len(slab.length))]
    grid, step = spark.range(math.prod(slab.length)), 1  # in as many tasks as the session has
    for n, length in zip(reversed(names), reversed(slab.length), strict=True):
        grid = grid.withColumn(n, (F.floor(F.col("id") / F.lit(step)) % length).cast("int"))
        step *= length
    for d, a in enumerate(axes):
        at = F.lit(slab.origin[d])
        for n, direction, stride in zip(names, slab.directions, slab.stride, strict=True):
            at = at + F.col(n) * direction[d] * stride
        grid = grid.withColumn(a, at.cast("long"))
    return grid.drop("id").join(df.select(*[F.col(a).cast("long").alias(a) for a in axes], value), axes, "left").select(*names, F.coalesce(value, F.lit(0.0)).alias(value))


def plane(df: DataFrame, fixed: dict[str, int]) -> DataFrame:
    for a, i in fixed.items():
        df = df.where(F.col(a) == i)
    return df


def diagonal(df: DataFrame, axes: list[str]) -> DataFrame:
    for a in axes[1:]:
        df = df.where(F.col(a) == F.col(axes[0]))
    return df


def slice_offset(local_coord=None, local_index=None, global_coord=None, global_index=None, default=0.0, origin: float = 0.0, delta: float = 1.0) -> int:
    """Index of a slice: a group's coordinate, its index, the global coordinate, the global index, then the default coordinate."""
    at = lambda x: math.floor((x - origin) / delta + 0.75)
    if local_coord is not None:
        return at(local_coord)
    if local_index is not None:
        return local_index
    if global_coord is not None:
        return at(global_coord)
    return global_index if global_index is not None else at(default)


def line_slab(df: DataFrame, axes: list[str], origin: tuple[int, ...], direction: tuple[int, ...], extent: int, downsample: int = 1, value: str = "v") -> DataFrame:
    """The older call for one line of points: every `downsample`-th of `extent` points from the origin."""
    return hyperslab(df, axes, Slab(origin, (direction,), (downsample,), (-(-extent // downsample),)), value)


def by_class(df: DataFrame, column: str, ghosts: bool = True, symmetry: bool = True, boundary: bool = True, buffers: bool = True) -> DataFrame:
    """Points without the classes that are left out; `column` names a point's class or is "interior"."""
    gone = [n for n, keep in (("ghost", ghosts), ("symmetry", symmetry), ("boundary", boundary), ("buffer", buffers)) if not keep]
    return df.where(~F.col(column).isin(*gone)) if gone else df


def first_places(df: DataFrame, bad: Column, order: list[str], n: int) -> DataFrame:
    """The first n places where a condition holds: a top-k, not a sort of all rows."""
    return df.where(bad).orderBy(*order).limit(n)
