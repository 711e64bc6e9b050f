"""Time levels: rotation, due levels, output cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cycle(tl: Column, n: int) -> Column:
    return F.pmod(tl + 1, F.lit(n))


def uncycle(tl: Column, n: int) -> Column:
    return F.pmod(tl - 1, F.lit(n))


def flip(tl: Column, n: int) -> Column:
    """Level 0 stays, the others change order."""
    return F.when(tl == 0, tl).otherwise(n - tl)


def fill(df: DataFrame, n: int, tl: str = "tl") -> DataFrame:
    """All n levels become copies of level 0."""
    return df.where(F.col(tl) == 0).withColumn(tl, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def newest(df: DataFrame, keys: list[str], time: str, n: int) -> DataFrame:
    """The newest n rows of each key with their level, 0 the newest."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    return df.withColumn("tl", F.row_number().over(w) - 1).where(F.col("tl") < n)


def due(it: Column, rl: Column, finest: int, factor: int = 2) -> Column:
    """Whether a level is evolved in an iteration of the finest level: (it - 1) is a multiple of its step."""
    return F.pmod(it - 1, F.pow(F.lit(float(factor)), F.lit(finest) - rl).cast("long")) == 0


def cadence_divisor(it: Column, n: int) -> Column:
    return F.pmod(it, F.lit(n)) == 0


def cadence_greedy(df: DataFrame, keys: list[str], at: str, step: float, eps: float = 1e-12) -> DataFrame:
    """Rows of each key at which output is due: the first, then each at least step after the last output.

    Sequential by nature, so a key's times are folded as one array.
    """
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(at).cast("double"))).alias("ts"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))

    def move(acc: Column, t: Column) -> Column:
        go = acc["last"].isNull() | (t >= acc["last"] + step - eps)
        return F.struct(F.when(go, t).otherwise(acc["last"]).alias("last"), F.when(go, F.concat(acc["out"], F.array(t))).otherwise(acc["out"]).alias("out"))

    return g.select(*keys, F.explode(F.aggregate("ts", start, move)["out"]).alias(at))


def advance(times: DataFrame, dt: float, levels: int, time: str = "time", tl: str = "tl") -> DataFrame:
    """Level 0 gets the next time and all others move up one; the oldest goes."""
    older = times.withColumn(tl, F.col(tl) + 1)
    return times.where(F.col(tl) == 0).withColumn(time, F.col(time) + dt).unionByName(older).where(F.col(tl) < levels)


def retreat(times: DataFrame, dt: float, levels: int, time: str = "time", tl: str = "tl") -> DataFrame:
    """The opposite of advance: the oldest level's time is a step before the one that was oldest."""
    newer = times.where(F.col(tl) > 0).withColumn(tl, F.col(tl) - 1)
    return times.where(F.col(tl) == levels - 1).withColumn(time, F.col(time) - dt).unionByName(newer)
