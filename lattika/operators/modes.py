"""Ways to say where the finer levels lie; each gives a table of boxes (rl, lo and hi of each axis)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.operators.regrid import flag_blocks


def _table(spark: SparkSession, axes: list[str], rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "rl int, " + ", ".join(f"{a}_lo long, {a}_hi long" for a in axes))


def base_level(spark: SparkSession, axes: list[str]) -> DataFrame:
    """No refinement."""
    return _table(spark, axes, [])


def centre(spark: SparkSession, domain: dict[str, tuple[int, int]], levels: int, factor: int = 2) -> DataFrame:
    """On each level the middle half of the extent of the one before, in that level's own indices."""
    rows, box = [], {a: (float(lo), float(hi)) for a, (lo, hi) in domain.items()}
    for rl in range(1, levels):
        box = {a: (lo + (hi - lo) / 4, hi - (hi - lo) / 4) for a, (lo, hi) in box.items()}
        rows.append((rl, *(x for lo, hi in box.values() for x in (math.ceil(lo * factor**rl), math.floor(hi * factor**rl)))))
    return _table(spark, list(domain), rows)


def gridpoint_list(spark: SparkSession, axes: list[str], boxes: list[list[dict[str, tuple[int, int]]]]) -> DataFrame:
    """Lists of boxes in indices, one list for each level from 1."""
    return _table(spark, axes, [(rl, *(x for a in axes for x in b[a])) for rl, level in enumerate(boxes, 1) for b in level])


def coordinate_list(spark: SparkSession, axes: list[str], boxes: list[list[dict[str, tuple[float, float]]]], origin: float, delta: float, factor: int = 2) -> DataFrame:
    """The same in coordinates, rounded to the nearest index of the level, halves up."""
    at = lambda x, rl: math.floor((x - origin) / (delta / factor**rl) + 0.5)
    return _table(spark, axes, [(rl, *(at(x, rl) for a in axes for x in b[a])) for rl, level in enumerate(boxes, 1) for b in level])


def moving(spark: SparkSession, axes: list[str], start: list[float], velocity: list[float], radius: list[float], time: float, origin: float, delta: float) -> DataFrame:
    """Boxes around a centre that moves on a line; a radius for each level from 1."""
    here = [s + v * time for s, v in zip(start, velocity, strict=True)]
    return coordinate_list(spark, axes, [[{a: (x - r, x + r) for a, x in zip(axes, here, strict=True)}] for r in radius], origin, delta)


def automatic(df: DataFrame, axes: list[str], error: str, most: float, block: int) -> DataFrame:
    """Blocks with a finite error above the threshold, in the finer level's indices."""
    bad = (F.col(error) > most) & (F.col(error) < float("inf")) & ~F.isnan(error)
    b = flag_blocks(df, axes, bad, block)
    return b.select(F.lit(1).alias("rl"), *[(F.col(f"{a}_lo") * 2).alias(f"{a}_lo") if e == "lo" else (F.col(f"{a}_hi") * 2 + 1).alias(f"{a}_hi") for a in axes for e in ("lo", "hi")])


def same_on_maps(df: DataFrame, maps: int) -> DataFrame:
    """The regions of one map, the same for all."""
    return df.withColumn("map", F.explode(F.array(*[F.lit(m) for m in range(maps)])))


def gaussian_flags(df: DataFrame, axes: list[str], width: float, level: float) -> DataFrame:
    """The example criterion: `level_mask` is the finest level whose threshold exp(-r2 / width) reaches."""
    r2 = sum((F.col(a) * F.col(a) for a in axes), F.lit(0.0))
    return df.withColumn("level_mask", F.floor(F.lit(level) * F.exp(-r2 / F.lit(width))).cast("int"))
