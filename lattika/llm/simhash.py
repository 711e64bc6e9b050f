"""SimHash near-dedup by a binary trie self-join.

Documents get 64-bit fingerprints in Arrow batches. Distinct fingerprints form a
binary trie; its nodes at a top depth are dealt out, each with those nodes that
differ from it in at most the allowed bits, and every task goes down pairs of
nodes together (kernels.trie_links). A task returns a spanning star of each group
of linked fingerprints instead of all pairs; alternating large-star and small-star
steps join the stars of all tasks. The top depth follows the number of distinct
fingerprints, so a task's share stays bounded. Exact copies share a fingerprint
and take part once.

Defined results: null, empty and blank texts have fingerprint zero and are linked
like any other; repeated rows are rows of one fingerprint; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.llm import kernels
from lattika.llm.common import attach_groups, by_value, cut

by_value(__name__)

BITS = 2
SHINGLE = 3
PER_NODE = 20_000  # distinct fingerprints of a top node, about


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kernels.simhashes(texts, shingle).view(np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def stars(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints within `bits` of each other."""
    n = prints.count()
    depth = max(6, min(16, math.ceil(math.log2(max(n, 1) / PER_NODE)))) if n > PER_NODE else 6
    flips = [0] + [1 << i for i in range(depth)] if bits >= 1 else [0]
    if bits >= 2:
        flips += [(1 << i) | (1 << j) for i in range(depth) for j in range(i)]
    if bits > 2:
        raise ValueError("at most 2 bits")
    top = F.shiftrightunsigned("fp", 64 - depth)
    dealt = prints.select("fp", F.explode(F.filter(F.transform(F.lit(flips), lambda x: top.bitwiseXOR(x.cast("long"))), lambda p: p <= top)).alias("node"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        node = np.uint64(pdf["node"].iloc[0])
        fp = np.sort(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64))
        root = kernels.trie_links(fp, (fp >> np.uint64(64 - depth)) == node, depth, bits)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[linked].view(np.int64), "b": fp[root[linked]].view(np.int64)})

    return dealt.groupBy("node").applyInPandas(join, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b), by large-star and small-star steps."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of those reachable): one row per row of docs."""
    d = cut(fingerprints(docs.select("doc_id", "text"), shingle))
    by_print = cut(d.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(stars(by_print.select("fp"), bits))
    rooted = by_print.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "n", "component_id")
    return attach_groups(d, named, "fp", "n", ["component_id"], F.xxhash64("doc_id"))


def simhash_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
