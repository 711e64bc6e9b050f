"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it (Java and RE2 syntax).
WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "lattika-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Reliable checkpoint: recomputed by nobody, readable by every executor.

    release: lets Spark's cleaner drop shuffle files at once that only the
    plan of df has used, instead of whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    del df  # its plan holds the shuffle files
    if release:
        _release(spark)
    return done


def _release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """Like cut, as Parquet in the shared folder: for tables whose rows are large. Removed at exit."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").option("parquet.enable.dictionary", "false").parquet(path)
    atexit.register(_remove, spark, path)
    del df
    _release(spark)
    return spark.read.parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove_folder(spark, path)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def words(text: Column) -> Column:
    """Array of maximal runs of non-white characters; null and blank give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building them: spaces between collapsed words, plus one."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS, " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, payload: list[str], spread: Column, hot_rows: int = 256, hot_groups: int = 64) -> DataFrame:
    """Left join of `groups` (one row a key, never null) to `rows`, safe for hot keys.

    The largest groups (at most `hot_groups` rows, so a bounded broadcast) are
    joined by broadcast. Their rows then take `spread` (a value of the key's
    type that differs from row to row) as join key, so no task gets them all.
    """
    hot = groups.where(F.col(size) >= hot_rows).orderBy(F.desc(size)).limit(hot_groups)
    hot = hot.select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in payload], F.lit(True).alias("_hot"))
    r = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    r = r.withColumn("_jk", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    g = groups.select(F.col(key).alias("_gk"), *[F.col(c).alias(f"_g_{c}") for c in payload])
    j = r.join(g, F.col("_jk") == F.col("_gk"), "left")
    return j.select(*rows.columns, *[F.when(F.col("_hot").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_g_{c}")).alias(c) for c in payload])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(xs: Column) -> Column:
    """The sum of the elements before each one of an array of numbers; blocks of sqrt(n) elements keep the sums short."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def sums(x: Column) -> Column:
        n = F.size(x)
        side = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / side).cast("int")), lambda b: total(F.slice(x, b * side + 1, side)))
        before = lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
        place = lambda w: F.transform(x, lambda _, i: F.element_at(w, (i / side).cast("int") + 1) + total(F.slice(x, (i / side).cast("int") * side + 1, i % side)))
        return F.when(n > 0, let(let(blocks, before), place)).otherwise(F.array().cast("array<bigint>"))

    return let(xs, sums)


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def by_value(module: str) -> None:
    """Ship a module's functions with the tasks, so that executors need not have the package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that carries the classes of its value along; read it with `opened`."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(held: Broadcast) -> Any:
    import pickle

    return pickle.loads(held.value)
