"""Masks and weights: one bit for each cell octant, weight = set bits / 2**D."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_space(axis: int, upper: bool, dim: int = 3) -> int:
    """Bits of the octants on one side of an axis."""
    return sum(1 << b for b in range(1 << dim) if bool(b >> axis & 1) == upper)


def boundary_mask(index: list[Column], first: list[Column], last: list[Column], dim: int | None = None) -> Column:
    """Octant bits of points between first and last interior index: whole inside, halved on a face, none outside.

    An axis with a single interior point is left alone.
    """
    dim = dim or len(index)
    mask = F.lit((1 << (1 << dim)) - 1)
    for d, (i, a, b) in enumerate(zip(index, first, last, strict=True)):
        keep = F.when((i < a) | (i > b), 0).when(a == b, (1 << (1 << dim)) - 1)
        keep = keep.when(i == a, half_space(d, True, dim)).when(i == b, half_space(d, False, dim)).otherwise((1 << (1 << dim)) - 1)
        mask = mask.bitwiseAND(keep)
    return mask


def weight(mask: Column, dim: int = 3) -> Column:
    return F.bit_count(mask) / F.lit(float(1 << dim))


def excise_spheres(df: DataFrame, axes: list[str], spheres: list[tuple[list[float], float]], weight_col: str, exterior: bool = False, squared: bool = False) -> DataFrame:
    """Weights zeroed inside (or outside) spheres; `excised` is the weight that went.

    squared: radii are given by their squares, as 0.01 is the square of no floating-point radius (0.1 * 0.1 is above it).
    """
    gone = F.lit(False)
    for centre, radius in spheres:
        r2 = sum((((F.col(a) - c) * (F.col(a) - c)) for a, c in zip(axes, centre, strict=True)), F.lit(0.0))
        bound = radius if squared else radius * radius
        gone = gone | ((r2 > bound) if exterior else (r2 <= bound))
    return df.withColumn("excised", F.when(gone, F.col(weight_col)).otherwise(F.lit(0.0))).withColumn(weight_col, F.when(gone, F.lit(0.0)).otherwise(F.col(weight_col)))


def excise_surface(df: DataFrame, table: DataFrame, x: str, y: str, z: str, n_theta: int, n_phi: int, shrink: float, weight_col: str) -> DataFrame:
    """Weights zeroed inside a star-shaped surface given by radii in (a, b) angle bins; an equi-join on the bins."""
    r = F.sqrt(F.col(x) ** 2 + F.col(y) ** 2 + F.col(z) ** 2)
    theta = F.acos(F.when(r > 0, F.col(z) / r).otherwise(F.lit(1.0)))
    phi = F.pmod(F.atan2(F.col(y), F.col(x)), F.lit(6.283185307179586))
    d = df.withColumn("a", F.least(F.floor(theta / F.lit(3.141592653589793) * n_theta), F.lit(n_theta - 1)).cast("int")).withColumn("b", F.least(F.floor(phi / F.lit(6.283185307179586) * n_phi), F.lit(n_phi - 1)).cast("int")).withColumn("_r", r)
    j = d.join(table.select("a", "b", "radius"), ["a", "b"], "left")
    return j.withColumn(weight_col, F.when(F.col("_r") <= F.col("radius") * shrink, F.lit(0.0)).otherwise(F.col(weight_col))).drop("_r", "a", "b", "radius")


def evolution_mask(coarse: DataFrame, fine: DataFrame, axes: list[str], factor: int = 2) -> DataFrame:
    """mask 0 where all children of a coarse point exist on the fine level, else 1."""
    parents = fine.select(*[F.floor(F.col(a) / F.lit(float(factor))).cast("long").alias(a) for a in axes], *[F.pmod(F.col(a), F.lit(factor)).alias(f"_{a}") for a in axes]).distinct()
    full = parents.groupBy(*axes).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == factor ** len(axes)).select(*axes, F.lit(0).alias("_m"))
    return coarse.join(full, axes, "left").withColumn("mask", F.coalesce("_m", F.lit(1))).drop("_m")


def ghost_mask(mask: Column, is_ghost: Column) -> Column:
    return F.when(is_ghost, F.lit(0)).otherwise(mask)


def refinement_mask(points: DataFrame, regions: DataFrame, axes: list[str], width: int, covered: bool) -> DataFrame:
    """points with `octants`: the octants of their cells that lie in any region (lo, hi vertices, inclusive, of the same index space).

    covered: for a coarse level, whose octants under a finer region count there: `iweight` loses them.
    Otherwise, for the fine level itself: `iweight` keeps these alone. So no volume counts twice,
    whatever regions overlap. A bucketed range join; regions add up by bits.
    """
    dim, every = len(axes), (1 << (1 << len(axes))) - 1
    a0 = axes[0]
    spread = F.sequence(F.floor(F.col(f"{a0}_lo") / F.lit(float(width))), F.floor(F.col(f"{a0}_hi") / F.lit(float(width))))
    r = regions.select(*[f"{a}_{e}" for a in axes for e in ("lo", "hi")]).distinct().withColumn("_b", F.explode(spread))
    p = points.select(*axes).distinct().withColumn("_b", F.floor(F.col(a0) / F.lit(float(width))))
    near, bits = F.lit(True), F.lit(every)
    for d, a in enumerate(axes):
        near = near & F.col(a).between(F.col(f"{a}_lo"), F.col(f"{a}_hi"))
        up = F.when(F.col(a) < F.col(f"{a}_hi"), half_space(d, True, dim)).otherwise(0)
        down = F.when(F.col(a) > F.col(f"{a}_lo"), half_space(d, False, dim)).otherwise(0)
        bits = bits.bitwiseAND(up.bitwiseOR(down))
    inside = p.join(r, "_b").where(near).groupBy(*axes).agg(F.bit_or(bits).alias("octants"))
    out = points.join(inside, axes, "left").withColumn("octants", F.coalesce("octants", F.lit(0)))
    keep = F.bitwise_not("octants") if covered else F.col("octants")
    return out.withColumn("iweight", F.col("iweight").bitwiseAND(keep).bitwiseAND(F.lit(every)))


def classify(is_boundary: Column, is_used: Column, substeps: Column) -> Column:
    """-1 on the boundary, 0 where unused, else the number of substeps up to which a point is used."""
    return F.when(is_boundary, F.lit(-1)).when(~is_used, F.lit(0)).otherwise(substeps)


def unused_mask(points: DataFrame, unused: DataFrame, axes: list[str]) -> DataFrame:
    """points with `unused` 1 where a table of points says so, else 0."""
    u = unused.select(*axes).distinct().withColumn("unused", F.lit(1))
    return points.join(u, axes, "left").withColumn("unused", F.coalesce("unused", F.lit(0)))
