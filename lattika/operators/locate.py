"""Point location: the finest region that holds a point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.operators.boxes import range_join


def locate_finest(points: DataFrame, regions: DataFrame, axes: list[str], width: float, key: str = "point_id") -> DataFrame:
    """point columns, rl, c and status: level and component of the finest region, the smallest component of equal ones.

    A left outer join: a point in no region keeps a null level and status -1.
    """
    a = axes[0]
    b = regions.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{a}_lo") / F.lit(width)), F.floor(F.col(f"{a}_hi") / F.lit(width)))))
    p = points.withColumn("_b", F.floor(F.col(a) / F.lit(width)))
    cond = p["_b"] == b["_b"]
    for x in axes:
        cond = cond & p[x].between(b[f"{x}_lo"], b[f"{x}_hi"])
    hit = p.join(b, cond).groupBy(p[key]).agg(F.max(F.struct(F.col("rl"), (-F.col("c")).alias("c"))).alias("m"))
    out = points.join(hit.select(key, F.col("m.rl").alias("rl"), (-F.col("m.c")).alias("c")), key, "left")
    return out.withColumn("status", F.when(F.col("rl").isNull(), -1).otherwise(0))


def locate_linear(points: DataFrame, regions: DataFrame, axes: list[str], width: float, key: str = "point_id") -> DataFrame:
    """The same answer over range_join, to cross-check."""
    hit = range_join(points, regions, axes, int(max(1, width))).groupBy(key).agg(F.max("rl").alias("rl"))
    return points.join(hit, key, "left")
