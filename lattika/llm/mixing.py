"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree
(DataFrame functions only).

1. Each document's size is its number of words; each source's target is its
   weight's share of all words, capped at a multiple of the source's words, the
   excess shared again by weight (water filling in closed form).
2. A source's documents fall into at most 4,096 blocks by digest. The quota of a
   source is exact: whole passes over all its blocks, then whole blocks in
   permuted order, then part of one block, then part of one document, so that a
   source's taken words are its target rounded to a word.
3. Splitting tree: the units (source, block, pass) are put in one random permutation
   by a seeded digest; the root holds all of it, and each node gives the lower half of
   its range to its left child and the rest to the right one, down to the output
   shards. So a node draws each source's count from the multivariate hypergeometric
   law, given its total, and the counts of siblings always add up to the quota above.
   A shard then takes, from every source, so many of the source's units in an order
   permuted for each source, disjoint from all other shards' (`shards`).
4. A document's taken words are the sum over the shards that its block went to, and
   `write_shards` shuffles each shard locally by `shuffle_key`.

Only the table of blocks (at most 4,096 a source and pass) meets in windows, split by
digest or source; documents meet in one only within the one block that the quota cuts.

Defined results: null text has size 0; a null source is a source of its own, the
last; sources without words have target 0; an empty table gives no rows; repeated
rows are documents of their own; other columns are ignored, or kept by `mixed`, where
columns of the mix replace those of the same name. A text is only counted, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattika.llm.common import cut, fresh, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SHARD_LEVELS = 5  # 2**5 output shards


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", (F.lit(cap) * F.col("source_size")).cast("double"))
    prior = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weight = F.sum("source_size").over(everything).cast("double"), F.sum("w").over(everything)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(prior), F.lit(0.0))) / (weight - F.coalesce(F.sum("w").over(prior), F.lit(0.0))))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything)
    # Sources are filled in order of cap / weight; the first that isn't full sets the level of all that follow
    # (the values computed at later ones are lower, hence the maximum).
    return s.withColumn("lam", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("lam") * F.col("w"), F.col("cap"))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, levels: int = SHARD_LEVELS, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, n_copies, shards, shuffle_key, draws: one row per row of docs.

    draws: array of (shard, pass, words), what each shard takes of the document; shards names them in order of
    the passes of the document's block, whether or not they take a word of this document.
    """
    d = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"))
    d = cut(d.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).withColumn("block", F.substring("digest", 1, 3)))
    blocks = d.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.count(F.lit(1)).alias("block_docs"))
    blocks = cut(blocks)
    t = targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, cap)
    t = t.withColumn("quota", F.round("target").cast("long")).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    b = blocks.alias("b").join(t.withColumnRenamed("source", "_s"), _same(F.col("source"), F.col("_s"))).drop("_s")
    order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("room", F.col("rest") - F.coalesce(F.sum("block_size").over(order), F.lit(0)))
    b = b.withColumn("part", F.when(F.col("room") <= 0, "none").when(F.col("room") >= F.col("block_size"), "all").otherwise("cut"))
    b = cut(_with_shards(b, levels, seed))
    named = b.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "source_size", "target", "passes", "room", "part", "units")
    rows = d.join(named, _same(F.col("source"), F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    whole = rows.where("part <> 'cut'").withColumn("room", F.col("size"))
    inside = Window.partitionBy("source", "block").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    divided = rows.where("part = 'cut'").withColumn("room", F.col("room") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = whole.unionByName(divided)
    # The last unit of a block takes what the quota has left for it, all others whole documents.
    def draw(u: Column) -> Column:
        rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room")))
        return F.struct(u["node"].alias("shard"), u["pass"].alias("pass"), F.when(u["pass"] > F.col("passes"), rest).otherwise(F.col("size")).cast("long").alias("words"))

    out = out.withColumn("draws", F.filter(F.transform("units", draw), lambda x: x["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    # Of a document without words, the whole passes count as copies.
    copies = F.when(F.col("size") > 0, F.size("draws")).otherwise(F.col("passes")).cast("long")
    shards = F.array_join(F.transform("units", lambda u: u["node"].cast("string")), ",")
    return out.select("doc_id", "source", *keep, "size", "source_size", "target", taken.alias("taken"), copies.alias("n_copies"), shards.alias("shards"), F.md5(F.concat(F.lit(seed), "digest")).alias("shuffle_key"), "draws")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes words of, with all columns and those of `mix`."""
    key, turn = fresh("key"), fresh("turn")
    # Rows of one doc_id, source and text are alike to the mix, so any of its rows for them fits.
    own = F.md5(F.concat_ws("\x01", F.col("doc_id").cast("string"), "source", "text"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))
    every = mix(docs.withColumn(key, own), keep=(key,), **how).drop("doc_id", "source")
    plan, kept = every.where("taken > 0"), docs.withColumn(key, own).drop(*[c for c in every.columns if c != key])
    if every.groupBy(key).count().where("count > 1").limit(1).count() == 0:
        # Texts move once, and unsorted, where no two rows are alike.
        return kept.join(plan.hint("shuffle_hash"), key).drop(key)
    return kept.withColumn(turn, rank).join(plan.withColumn(turn, rank), [key, turn]).drop(key, turn)


def write_shards(mix_rows: DataFrame, path: str) -> None:
    """The documents of `mixed` by shard, a row for each draw: shards in folders, each in its own shuffled order."""
    each = mix_rows.withColumn("draw", F.explode("draws")).drop("draws", "shards")
    each = each.select("*", F.col("draw.shard").alias("shard"), F.col("draw.pass").alias("pass"), F.col("draw.words").alias("words")).drop("draw")
    order = F.md5(F.concat_ws("|", "shuffle_key", F.col("shard").cast("string"), F.col("pass").cast("string")))
    each = each.withColumn("shuffle_key", order)
    each.repartitionByRange("shard", "shuffle_key").sortWithinPartitions("shard", "shuffle_key").write.partitionBy("shard").parquet(path)


def _with_shards(b: DataFrame, levels: int, seed: str) -> DataFrame:
    """b with `units`: for each pass of a block (in order), the output shard that draws it, as (pass, node)."""
    n = (F.col("passes") + F.when(F.col("part") != "none", 1).otherwise(0)).cast("int")
    b = b.withColumn("n_units", n)
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    units = b.where("n_units > 0").select(name.alias("name"), "block", F.explode(F.sequence(F.lit(1), "n_units")).alias("pass"))
    quota = _tree(units, levels, seed)
    upto = F.sum("n").over(Window.partitionBy("name").orderBy("node"))
    ranges = quota.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("n"))
    permuted = F.row_number().over(Window.partitionBy("name").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "name", F.col("pass").cast("string"), "block")), "pass", "block")) - 1
    placed = units.withColumn("k", permuted).join(ranges.withColumnRenamed("name", "_name"), (F.col("name") == F.col("_name")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")))
    shards = placed.groupBy("name", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "node"))).alias("units"))
    keyed = b.withColumn("name", name)
    return keyed.join(shards, ["name", "block"], "left").withColumn("units", F.coalesce("units", F.array().cast("array<struct<pass:int,node:int>>"))).drop("name", "n_units")


def _tree(units: DataFrame, levels: int, seed: str) -> DataFrame:
    """(name, node, n): how many units of each source every leaf of the splitting tree has drawn."""
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.lit("tree"), "name", "block", F.col("pass").cast("string")))
    u = units.select("name", "block", "pass", drawn.alias("drawn"), F.substring(drawn, 1, 3).alias("part"))
    # The place in the permutation: 4,096 parts by digest, whose sizes alone meet in one window.
    parts = u.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    parts = parts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy()).alias("n"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("drawn", "name", "block", "pass"))
    t = u.withColumn("r", place).join(parts, "part").select("name", (F.col("r") + F.col("before")).alias("r"), "n", F.lit(0).alias("node"))
    for _ in range(levels):
        half = F.floor(F.col("n") / 2)
        left = F.col("r") <= half
        t = t.select("name", F.when(left, F.col("r")).otherwise(F.col("r") - half).alias("r"), F.when(left, half).otherwise(F.col("n") - half).alias("n"), (F.col("node") * 2 + F.when(left, 0).otherwise(1)).cast("int").alias("node"))
    return t.groupBy("name", "node").agg(F.count(F.lit(1)).alias("n"))
