"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is white-space normalised and cut into chunks at content-defined places,
so equal texts have equal chunk lists. A chunk's identifier is its 64-bit hash;
the identifiers are verified: distinct (hash, content) pairs are counted and,
where two contents share a hash, every such content gets an ordinal of its own.
Then equal texts are exactly the documents with equal ordered identifier lists.
Chunk contents move once, in the verification; afterwards only identifier lists
do, however long a document is.

Defined results: null text counts as empty; empty and blank texts are documents
like any other (all empty ones are one group, all blank ones another); rows that
repeat a doc_id with an equal text are the same document, so all of them are kept or none;
a null doc_id comes before none and is a kept one only among its like; an empty table gives no
rows; other columns are ignored. A text is cut as a whole, however long, within its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattika.llm.common import WS, attach_groups, cut

MIN_CHUNK, MAX_CHUNK = 1024, 8192


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Chunks of `least` characters up to the next word that ends in a, d, e, n or r; of `most` at the longest.

    The cut depends on the text since the last cut alone; chunks concatenate to the text.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?[aednr] |.{{1,{most}}}"), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks: one row per row of docs."""
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    exploded = texts.select("doc_id", F.posexplode(chunks(F.col("t"), least, most)).alias("pos", "chunk")).withColumn("h", chunk_hash(F.col("chunk")).cast("long"))
    pairs = exploded.select("h", "chunk").distinct()
    collided = cut(pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    recipes = texts.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.transform(chunks(F.col("t"), least, most), lambda c: chunk_hash(c).cast("long")).alias("recipe"))
    if not collided.isEmpty():
        recipes = _disambiguated(recipes, exploded, pairs, collided)
    recipes = cut(recipes)
    # Lists decide who is equal; the answer goes back by the digest, which equal texts share and whose size is fixed.
    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("text_sha256").alias("digest")).drop("recipe")
    spread = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    out = attach_groups(recipes, groups.withColumnRenamed("digest", "text_sha256"), "text_sha256", "group_size", ["keep_id", "group_size"], spread)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def _disambiguated(recipes: DataFrame, exploded: DataFrame, pairs: DataFrame, collided: DataFrame) -> DataFrame:
    """Recipes followed by the ordinals of those chunks whose hash two contents share."""
    shared = pairs.join(collided, "h", "left_semi")
    least = shared.select("h", F.sha2("chunk", 512).alias("d"), "chunk")
    ordinal = least.select("h", "chunk", F.conv(F.substring("d", 1, 15), 16, 10).cast("long").alias("ordinal"))
    marks = exploded.join(collided, "h", "left_semi").join(ordinal, ["h", "chunk"]).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "ordinal"))), lambda x: x["ordinal"]).alias("_marks"))
    joined = recipes.join(marks.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "text_sha256", F.concat("recipe", F.coalesce("_marks", F.array().cast("array<bigint>"))).alias("recipe"))
