"""Text slices and reduction files: read any of the column layouts, write the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FULL = ["it", "tl", "rl", "c", "ml", "ix", "iy", "iz", "time", "x", "y", "z"]
INTEGERS = {"it", "tl", "rl", "c", "ml", "ix", "iy", "iz"}


def read_slices(spark: SparkSession, path: str, values: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of slice files: comments and blank lines are skipped, columns split at any white space; a line of another width fails."""
    names = [*(columns or FULL), *values]
    parts = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    whole = F.when(F.size("p") == len(names), True).otherwise(F.raise_error(F.concat(F.lit(f"not {len(names)} columns: "), F.array_join("p", " "))).cast("boolean"))
    return parts.where(whole).select(*[F.try_element_at("p", F.lit(k + 1)).cast("int" if n in INTEGERS else "double").alias(n) for k, n in enumerate(names)])


def read_scalars(spark: SparkSession, path: str, values: list[str]) -> DataFrame:
    return read_slices(spark, path, values, ["it", "time"])


def write_slices(df: DataFrame, path: str, values: list[str], columns: list[str] | None = None, order: list[str] | None = None) -> None:
    """One row a line, tab separated, sorted within files; complex values (struct re, im) are two columns."""
    flat = []
    for n in [*(columns or FULL), *values]:
        kind = dict(df.dtypes)[n]
        flat += [F.col(f"{n}.re"), F.col(f"{n}.im")] if kind.startswith("struct") else [F.col(n)]
    lines = df.sortWithinPartitions(*(order or [c for c in (columns or FULL) if c in df.columns])).select(F.concat_ws("\t", *[c.cast("string") for c in flat]).alias("value"))
    lines.write.mode("overwrite").text(path)


def screen_table(df: DataFrame, columns: list[str], width: int = 14, digits: int = 6) -> DataFrame:
    """Lines of a fixed-width table; very large and very small numbers in scientific form."""
    cells = []
    for n in columns:
        if dict(df.dtypes)[n] in ("double", "float"):
            sci = (F.abs(n) >= 1e8) | ((F.abs(n) < 1e-3) & (F.col(n) != 0))
            text = F.when(sci, F.format_string(f"%.{digits}e", F.col(n).cast("double"))).otherwise(F.format_string(f"%.{digits}f", F.col(n).cast("double")))
        else:
            text = F.col(n).cast("string")
        cells.append(F.lpad(text, width, " "))
    return df.select(F.concat_ws(" | ", *cells).alias("line"))


def merge_restarts(*runs: DataFrame, keys: list[str], it: str = "it") -> DataFrame:
    """Later runs replace earlier ones from their first iteration on."""
    out = runs[0]
    for r in runs[1:]:
        first = r.agg(F.min(it).alias("_f"))
        out = out.join(F.broadcast(first), F.col("_f").isNull() | (F.col(it) < F.col("_f"))).drop("_f").unionByName(r)
    first = Window.partitionBy(it, *keys).orderBy(*[c for c in out.columns if c not in (it, *keys)])  # of repeated rows always the same one
    return out.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
