"""SimHash near-dedup at a similarity: trie self-joins of several prints, verified.

The operator of `simhash` for a similarity instead of a few bits. A document is the
set of its shingles (`SHINGLE` lower-case words; a shorter document is one shingle);
equal sets become one, named by 64 bits of their digest. A set gets a SimHash of
`POOL` 64-bit words. Two sets of Jaccard similarity 0.8 differ in 15 % of its bits,
far beyond the budget of any one trie, so there are several tries: each over a print
of so many bits of the pool, drawn by seed, that unlike sets seldom meet, and with a
budget of BUDGET bits. Their number follows from RECALL: at the similarity itself a
pair is within budget in at least one trie with that probability, above it with more.
Pairs of nodes go down a trie together and are pruned beyond the budget
(kernels.trie_join); the rest of the pool and the sizes of the sets sieve the pairs.
Every pair left is verified: the shingles of both texts are compared as sets (of
64-bit fingerprints).

Phase 1 takes, for each set, its first neighbour in each of LEADERS random orders,
which settles large groups of near copies. Phase 2 joins the sets that have more
neighbours than these, and takes all pairs that are not in one group yet, so no pair
is left out and no group emits all its pairs. Groups are those reachable over
verified pairs.

Defined results: null, empty and blank texts are equal; repeated rows are copies of one
set; a null doc_id counts as the largest; an empty table gives no rows; other columns
are ignored. Texts are handled in slices of about a megabyte; a longer one is a slice of
its own, and its shingles, some ten times over, must fit a task.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattika.llm import kernels
from lattika.llm.blocks import loosen, squeeze
from lattika.llm.common import attach_groups, by_value, cut, fresh
from lattika.llm.simhash import components

by_value(__name__)

SIMILARITY, SHINGLE = 0.8, 5
POOL = 8  # words of 64 bits
BUDGET = 1  # bits, in each trie
RECALL = 0.999
SPARE = 16  # unlike sets that meet a set in one trie, about
PER_TRIE = 1 << 18  # sets of one task, about
LEADERS = 3
SLICE = 1 << 20  # bytes of text handled at once, about


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's shingles; [0] without words."""
    words, counts = kernels.word_hashes(b"".join(b" ".join(t.lower().split()) + b"\n" for t in texts))
    grams, begin, out = kernels.rolling(words, shingle), np.cumsum(counts) - counts, []
    for b, n in zip(begin, counts, strict=True):
        if n >= shingle:
            out.append(np.unique(grams[b : b + n - shingle + 1]))
        else:
            out.append(kernels.rolling(words[b : b + n], int(n)) + np.uint64(n) if n else np.zeros(1, np.uint64))
    return out


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def pool(sets: list[np.ndarray], words: int = POOL) -> np.ndarray:
    """SimHash of `words` words for each set: a row of them."""
    out = np.empty((len(sets), words), np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    for lo, hi in kernels._runs(size, 1 << 18):
        flat = np.concatenate(sets[lo:hi])
        for k, salt in enumerate(kernels.random_words(words, 101)):
            out[lo:hi, k] = kernels.majority(kernels.mixed(flat ^ salt), size[lo:hi])
    return out


def differing(similarity: float) -> float:
    """Share of differing bits in the SimHash of two sets of equal size and this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tries(n: int, similarity: float) -> tuple[int, int, int]:
    """Bits of a print, number of tries, and depth at which a trie is dealt out, for n sets."""
    def ball(d: int) -> int:
        return sum(math.comb(d, i) for i in range(BUDGET + 1))

    bits = 8
    while n * ball(bits) > SPARE * 2**bits and bits < 60:
        bits += 1
    p = differing(similarity)
    met = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(BUDGET + 1))
    depth = 0
    while depth < bits and n * ball(depth) > PER_TRIE * 2**depth:
        depth += 1
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - met))), depth


def prints(p: np.ndarray, trie: int, bits: int) -> np.ndarray:
    """The bits of the pool that a trie takes, as the highest ones of a word."""
    out = np.zeros(len(p), np.uint64)
    drawn = np.argsort(kernels.random_words(64 * p.shape[1], 5000 + trie), kind="stable")[:bits]
    for k, i in enumerate(drawn):
        out |= ((p[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) << np.uint64(63 - k)
    return out


def _parts(b: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about SLICE bytes of text, and their texts."""
    texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(at)]
    for lo, hi in kernels._runs(np.array([len(t) + 1 for t in texts], np.int64), SLICE):
        yield b.slice(lo, hi - lo), texts[lo:hi]


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (of the shingle set), n (its size), pool: one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _parts(b, 1):
                sets = shingle_sets(texts, shingle)
                keys = pa.array([set_key(s) for s in sets], pa.int64())
                words = pa.array([x.tobytes() for x in pool(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), keys, pa.array([len(s) for s in sets], pa.int64()), words], names=["doc_id", "key", "n", "pool"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, n long, pool binary")


def keyed_texts(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """key, text: a text of each shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in _parts(b, 0):
                keys = pa.array([set_key(s) for s in shingle_sets(texts, shingle)], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, part.column(0)], names=["key", "text"])

    return docs.select("text").mapInArrow(run, "key long, text string")


def verified(docs: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (x, y) of keys whose shingle sets have the similarity."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct()
    # Copies become one text before they move.
    texts = keyed_texts(docs, shingle).groupBy("key").agg(F.first("text").alias("text")).join(ids, "key", "left_semi")
    texts = cut(texts)
    both = pairs.join(texts.select(F.col("key").alias("x"), F.col("text").alias("a")), "x").join(texts.select(F.col("key").alias("y"), F.col("text").alias("b")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                x, y = b.column(0).to_pylist(), b.column(1).to_pylist()
                texts = dict(zip(x + y, [*b.column(2), *b.column(3)], strict=True))
                sets = dict(zip(texts, shingle_sets([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.values()], shingle), strict=True))
                near = []
                for p, q in zip(x, y, strict=True):
                    s, t = sets[p], sets[q]
                    common = len(s) + len(t) - len(np.union1d(s, t))
                    near.append(common >= similarity * (len(s) + len(t) - common) - 1e-9)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(near, pa.bool_()))

    return both.select("x", "y", "a", "b").mapInArrow(run, "x long, y long")


def _dealt(sets: DataFrame, bits: int, n_tries: int, depth: int) -> DataFrame:
    """(bucket, blob): the sets of a batch for each trie and node that they may have neighbours in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, n, root = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            p = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(len(key), -1)
            buckets, blobs = [], []
            for t in range(n_tries):
                own = prints(p, t, bits)
                cols = np.stack([own, *(x.astype(np.int64).view(np.uint64) for x in (key, n, root)), p[:, 0], p[:, 1]], axis=1)
                top = (own >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(own), np.int64)
                for flip in [0] + [sum(1 << i for i in c) for k in range(1, BUDGET + 1) for c in itertools.combinations(range(depth), k)]:
                    node = top ^ flip
                    order = np.flatnonzero(node <= top)  # each pair of nodes meets once, in the lower one
                    order = order[np.argsort(node[order], kind="stable")]
                    for lo, hi in kernels.spans(node[order]):
                        buckets.append((t << depth) + int(node[order[lo]]))
                        blobs.append(squeeze(cols[order[lo:hi]]))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return sets.select("key", "n", "root", "pool").mapInArrow(run, "bucket long, blob binary")


def _near(prints: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows (print, key, n, root, two words of the pool) the sizes and the pool allow."""
    p = differing(similarity)
    most = int(128 * p + 4.5 * math.sqrt(128 * p * (1 - p)))
    n = prints[:, 2].astype(np.int64)
    bits = np.bitwise_count(prints[x, 4] ^ prints[y, 4]).astype(np.int64) + np.bitwise_count(prints[x, 5] ^ prints[y, 5])
    return (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9) & (bits <= most) & (prints[x, 3] != prints[y, 3])


def _join(dealt: DataFrame, bits: int, depth: int, similarity: float, every: bool) -> DataFrame:
    """x, y, r, more: with every, all pairs of a trie (r and more are 0); else for each set its first neighbour in order r, and whether it has others."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([loosen(b, np.uint64).reshape(-1, 6) for b in pdf["blob"]])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        node = np.uint64(int(pdf["bucket"].iloc[0]) & ((1 << depth) - 1))
        home = (rows[:, 0] >> np.uint64(64 - depth)) == node if depth else np.ones(len(rows), bool)
        found: list[np.ndarray] = []
        turns = [np.argsort(np.argsort(kernels.mixed(rows[:, 1] ^ s), kind="stable"), kind="stable") for s in kernels.random_words(LEADERS, 31)]
        least, most = ([np.full(len(rows), v, np.int64) for _ in turns] for v in (len(rows), -1))

        def take(x: np.ndarray, y: np.ndarray) -> None:
            good = _near(rows, x, y, similarity)
            x, y = x[good], y[good]
            if every:
                found.append(np.unique(np.sort(rows[np.stack((x, y), axis=1), 1].view(np.int64), axis=1), axis=0))
                return
            for a, b in ((x, y), (y, x)):
                for r, turn in enumerate(turns):
                    np.minimum.at(least[r], a, turn[b])
                    np.maximum.at(most[r], a, turn[b])

        kernels.trie_join(rows[:, 0], home, depth, BUDGET, take, bits)
        key = rows[:, 1].view(np.int64)
        if every:
            pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
            return pd.DataFrame({"x": pairs[:, 0], "y": pairs[:, 1], "r": 0, "more": 0})
        out = []
        for r, turn in enumerate(turns):
            at = np.flatnonzero(most[r] >= 0)
            back = np.argsort(turn, kind="stable")
            out.append(pd.DataFrame({"x": key[at], "y": key[back[least[r][at]]], "r": r, "more": (least[r][at] < most[r][at]).astype(np.int64)}))
        return pd.concat(out).astype("int64")

    return dealt.groupBy("bucket").applyInPandas(run, "x long, y long, r long, more long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _first(found: DataFrame) -> DataFrame:
    """x, firsts (its first neighbour over all tries in each order), more (whether it has others)."""
    salts = F.element_at(F.array(*[F.lit(int(s) - (1 << 64) if int(s) >> 63 else int(s)) for s in kernels.random_words(LEADERS, 31)]), (F.col("r") + 1).cast("int"))
    each = found.groupBy("x", "r").agg(F.min_by("y", F.xxhash64(F.col("y").bitwiseXOR(salts))).alias("y"), F.count_distinct("y").alias("c"), F.max("more").alias("more"))
    return each.groupBy("x").agg(F.collect_set("y").alias("firsts"), F.max(F.greatest("more", (F.col("c") > 1).cast("long"))).alias("more"))


def _rooted(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """sets with the root of each key's group."""
    roots = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return sets.join(roots.withColumnRenamed("fp", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, component_id (smallest doc_id of those reachable): one row per row of docs."""
    d = cut(signatures(docs, shingle))
    sets = cut(d.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("pool").alias("pool")))
    shape = tries(sets.count(), similarity)
    bits, _, depth = shape
    alone = sets.select("key", "n", F.col("key").alias("root"), "pool")
    first = cut(_first(_join(_dealt(alone, *shape), bits, depth, similarity, False)), release=True)
    tried = cut(_ordered(first.select("x", F.explode("firsts").alias("y"))))
    some = cut(verified(docs, tried, similarity, shingle))
    busy = first.where("more > 0").select(F.col("x").alias("key"))
    edges = some
    if not busy.isEmpty():
        rooted = _rooted(alone.drop("root").join(busy, "key"), some)
        rest = cut(_ordered(_join(_dealt(rooted, *shape), bits, depth, similarity, True)).join(tried, ["x", "y"], "left_anti"), release=True)
        if not rest.isEmpty():
            edges = some.unionByName(cut(verified(docs, rest, similarity, shingle)))
    rooted = _rooted(sets.select("key", "least", "copies"), edges)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("key", "copies", "component_id")
    return attach_groups(d.select("doc_id", "key"), named, "key", "copies", ["component_id"], F.xxhash64("doc_id")).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group: of the smallest doc_id (null last), then digest of the text; all columns are kept."""
    key, turn = fresh("key"), fresh("turn")
    docs = docs.withColumn(key, F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")))
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key")).alias("doc_id"), "text")
    groups = near_duplicates(named, similarity, shingle)
    stays = groups.where("doc_id = component_id OR (doc_id.none AND component_id.none AND doc_id.key = component_id.key)").select(F.col("doc_id.key").alias(key)).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))  # rows of one key have the same id and text
    return docs.join(stays, key, "left_semi").withColumn(turn, rank).where(F.col(turn) == 1).drop(key, turn)
