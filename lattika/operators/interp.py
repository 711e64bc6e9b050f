"""Interpolation of lattice values at arbitrary points: a reusable stencil plan, then one join and one sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _axis_weights(x: Column, order: int) -> list[tuple[Column, Column]]:
    """(index, weight) of order + 1 lattice points around x."""
    n = order + 1
    first = (F.floor(x) - (n // 2 - 1)) if n % 2 == 0 else (F.floor(x + 0.5) - n // 2)
    out = []
    for k in range(n):
        w = F.lit(1.0)
        for j in range(n):
            if j != k:
                w = w * (x - (first + j)) / F.lit(float(k - j))
        out.append(((first + k).cast("long"), w))
    return out


def plan(points: DataFrame, axes: list[str], order: int, key: str = "point_id") -> DataFrame:
    """(key, index of each axis, weight): persist it to interpolate many variables at the same points."""
    out = points.select(key, *[F.col(a).alias(f"_x{a}") for a in axes], F.lit(1.0).alias("weight"))
    for a in axes:
        parts = F.array(*[F.struct(i.alias("i"), w.alias("w")) for i, w in _axis_weights(F.col(f"_x{a}"), order)])
        out = out.withColumn("_s", F.explode(parts)).withColumn(a, F.col("_s.i")).withColumn("weight", F.col("weight") * F.col("_s.w")).drop("_s")
    return out.select(key, *axes, "weight")


def apply(stencils: DataFrame, grid: DataFrame, axes: list[str], values: list[str], order: int, key: str = "point_id") -> DataFrame:
    """Values at the points of a plan; a point whose stencil leaves the lattice gets null and status -1.

    A null in the stencil makes that variable null at the point, and no other.
    """
    need = (order + 1) ** len(axes)
    j = stencils.join(grid.select(*axes, *values, F.lit(1).alias("_in")), axes, "left")
    g = j.groupBy(key).agg(F.count("_in").alias("_n"), *[F.when(F.count(v) == need, F.sum(F.col("weight") * F.col(v))).alias(v) for v in values])
    return g.select(key, *values, F.when(F.col("_n") == need, 0).otherwise(-1).alias("status"))


def eno2(points: DataFrame, grid: DataFrame, axis: str, value: str = "v", key: str = "point_id") -> DataFrame:
    """Parabola, along an axis, through the two lattice points around a point and the third one on the smoother side.

    Smoother: the smaller second difference, the left one of equal. Null where its points are missing.
    """
    from lattika.operators.transfer import neighbours

    n = neighbours(grid.select(axis, value), [axis], value, {"a": (-1,), "b": (0,), "c": (1,), "d": (2,)}).withColumnRenamed(axis, "_i")
    p = points.select(key, F.col(axis).alias("_x")).withColumn("_i", F.floor("_x").cast("long"))
    a, b, c, d = (F.col(x) for x in "abcd")
    f = F.col("_x") - F.col("_i")
    left, right = a - 2 * b + c, b - 2 * c + d
    by_left = b + f * (c - b) + f * (f - 1) / 2 * left
    by_right = b + f * (c - b) + f * (f - 1) / 2 * right
    return p.join(n, "_i", "left").select(key, F.when(F.abs(left) <= F.abs(right), by_left).otherwise(by_right).alias(value))


def interpolate(points: DataFrame, grids: dict[int, DataFrame], axes: list[str], values: list[str], order: int = 1, source_map: int | None = None, operands: list[int] | None = None, key: str = "point_id") -> DataFrame:
    """Several variables at points of several maps: `map` of a point, or `source_map` for all; `operands` picks outputs by number, with repeats."""
    stencils, out = plan(points, axes, order, key), None
    for m, grid in grids.items():
        own = stencils if source_map is not None else stencils.join(points.where(F.col("map") == m).select(key), key, "left_semi")
        if source_map is None or m == source_map:
            part = apply(own, grid, axes, values, order, key)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no map to interpolate from")
    chosen = [values[k] for k in operands] if operands is not None else values
    return out.select(key, *[F.col(v).alias(f"out{k}") for k, v in enumerate(chosen)], "status")
