"""Tools over written grids: slices, recombination of chunks, dumps of the grid structure."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Options of the Parquet sink that the options of the file formats map to.
COMPRESSION = {0: "uncompressed", 1: "snappy", 9: "zstd"}


def output_options(level: int = 1, checksum: bool = False, index: bool = True) -> dict[str, str]:
    """Writer options for a compression level of 0 to 9, page checksums and column indexes."""
    if not 0 <= level <= 9:
        raise ValueError("compression level from 0 to 9")
    codec = COMPRESSION[0] if level == 0 else COMPRESSION[9] if level > 5 else COMPRESSION[1]
    return {"compression": codec, "parquet.page.write-checksum.enabled": str(checksum).lower(), "parquet.bloom.filter.enabled": str(index).lower()}


def slicer(df: DataFrame, out: list[str], at: dict[str, int], value: str = "v") -> DataFrame:
    """A slice of a grid, finest level first: of several levels, the value of the finest that has a point (rl, axes in units of its level)."""
    cut = df
    for a, i in at.items():
        cut = cut.where(F.col(a) == i)
    finest = F.max(F.struct("rl", F.col(value).alias("v"))).alias("m")
    return cut.groupBy(*out).agg(finest).select(*out, F.col("m.rl").alias("rl"), F.col("m.v").alias(value))


def recombine(chunks: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """One grid from the chunks of many writers: where they overlap, the chunk of the smallest number c has its way."""
    w = Window.partitionBy(*keys).orderBy("c")
    return chunks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "c").select(*keys, value)


def dump_regions(df: DataFrame, axes: list[str]) -> DataFrame:
    """A line for each region: level, component and ([lo]:[hi]:[stride])."""
    vec = lambda e: F.concat(F.lit("["), F.concat_ws(",", *[F.col(f"{a}_{e}").cast("string") for a in axes]), F.lit("]"))
    stride = F.concat(F.lit("["), F.concat_ws(",", *[F.col("stride").cast("string") for _ in axes]), F.lit("]"))
    return df.select("rl", "c", F.concat(F.lit("("), vec("lo"), F.lit(":"), vec("hi"), F.lit(":"), stride, F.lit(")")).alias("region"))


def parse_regions(spark: SparkSession, text: str, axes: list[str]) -> DataFrame:
    """Regions of a list of lists "[ [ ([lo]:[hi]:[stride]), ... ], ... ]", a list for each level."""
    rows = []
    depth, rl, c = 0, -1, 0
    for token in re.findall(r"\(\[[^\]]*\]:\[[^\]]*\]:\[[^\]]*\]\)|\[|\]", text):
        if token == "[":
            depth += 1
            if depth == 2:
                rl, c = rl + 1, 0
        elif token == "]":
            depth -= 1
        else:
            lo, hi, stride = ([int(x) for x in part.split(",")] for part in re.findall(r"\[([^\]]*)\]", token))
            if not len(lo) == len(hi) == len(axes):
                raise ValueError(f"{token}: not {len(axes)} axes")
            rows.append((rl, c, *(x for pair in zip(lo, hi, strict=True) for x in pair), stride[0]))
            c += 1
    if depth:
        raise ValueError("brackets don't match")
    return spark.createDataFrame(rows, "rl int, c int, " + ", ".join(f"{a}_lo long, {a}_hi long" for a in axes) + ", stride long")
