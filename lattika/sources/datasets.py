"""Grid datasets as Parquet, their names, and checkpoints with a manifest."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DatasetName:
    """`var it=<n> tl=<n> [ml=<n>] [m=<n>] rl=<n> [c=<n>]`."""

    var: str
    it: int
    tl: int = 0
    ml: int | None = None
    m: int | None = None
    rl: int = 0
    c: int | None = None

    def __str__(self) -> str:
        d = asdict(self)
        return " ".join([self.var, *(f"{k}={d[k]}" for k in ("it", "tl", "ml", "m", "rl", "c") if d[k] is not None)])

    @classmethod
    def parse(cls, text: str) -> DatasetName:
        var, *rest = re.split(r"\s+(?=(?:it|tl|ml|m|rl|c)=)", text.strip())
        return cls(var, **{k: int(v) for k, v in (x.split("=") for x in rest)})


def write_grid(df: DataFrame, path: str, var: str, it: int) -> None:
    """A variable at an iteration; partitioned so that level and iteration prune files."""
    df.withColumn("var", F.lit(var)).withColumn("it", F.lit(it)).write.mode("append").partitionBy("var", "it", "rl").parquet(path)


def read_grid(spark: SparkSession, path: str, var: str | None = None, it: int | None = None, rl: int | None = None, box: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The part of a grid that is asked for; partition and row-group pruning come from the filters."""
    df = spark.read.parquet(path)
    if var is not None:
        df = df.where(F.col("var").rlike(f"^(?:{var})$"))
    for name, value in (("it", it), ("rl", rl)):
        if value is not None:
            df = df.where(F.col(name) == value)
    for a, (lo, hi) in (box or {}).items():
        df = df.where(F.col(a).between(lo, hi))
    return df


def write_checkpoint(spark: SparkSession, path: str, it: int, tables: dict[str, DataFrame], parameters: dict) -> str:
    """Tables and a manifest under path/it=<n>; the manifest comes last, so a checkpoint without one doesn't count."""
    at = f"{path}/it={it}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")
    text = json.dumps({"it": it, "tables": sorted(tables), "parameters": parameters}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")
    return at


def recover(spark: SparkSession, path: str) -> tuple[int, dict, dict[str, DataFrame]] | None:
    """The newest whole checkpoint: iteration, parameters, tables."""
    try:
        found = spark.read.text(f"{path}/it=*/manifest").collect()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no checkpoint yet
            return None
        raise
    best = max((json.loads(r["value"]) for r in found), key=lambda m: m["it"], default=None)
    if best is None:
        return None
    return best["it"], best["parameters"], {n: spark.read.parquet(f"{path}/it={best['it']}/{n}") for n in best["tables"]}


def checkpoint_due(it: int, last: int | None, every: int, final: bool = False, on_demand: bool = False) -> bool:
    if final:
        return last != it
    return on_demand or (every > 0 and (last is None or it >= last + every))
