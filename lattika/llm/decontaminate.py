"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

An item of m words and a part of a document match when at most a fifth of m word
edits turn one into the other (similarity 0.8 or more). The CGK random walk embeds
item and windows: step t writes the current word and moves on if a random bit of
(t, word) says so, so that few edits leave most steps of two walks equal: edit
distance becomes Hamming distance. Each of `repeats` walks samples `bits` of its
first `steps` steps and hashes them to a table. An item enters each table from up to
`OFFSETS` places of its own, evenly spaced, so that edits near its start don't hide
it; a window starts at every word of every document. A window that meets an item in
any table is a candidate, at the item's size around the place that the meeting implies.

Candidates whose words can't reach the similarity in any order go; the others are
verified by the exact edit distance to the best part of the window. Tables miss a few
matches of many edits: at the full allowance, with edits spread at random, 0.94 of
those of 12 words are found and over 0.99 of those of 20 or more (measured; tested to
be 0.9 at least). Exact matches are always found.

Words are lower-case runs of anything but white space and ASCII punctuation. Items
of under `least` words match exactly or not at all; those without words match nothing.
Items travel to the executors in blocks of bounded size, one pass over the documents
for each. An executor reads texts in slices of some megabytes; a longer document is a
slice of its own, and its words, a few times over, must fit a task.

Defined results: null and empty texts match nothing; an item that occurs several
times in a document gives one row, of its best occurrence, the earliest of equal
ones; repeated rows give repeated rows; empty tables give no rows; other columns
are ignored, or kept by `clean`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.llm import kernels
from lattika.llm.common import by_value, fresh, opened, shared

by_value(__name__)

SIMILARITY, LEAST = 0.8, 5
REPEATS, BITS, STEPS = 14, 6, 12
OFFSETS = 8
SLICE = 4 << 20  # bytes of text handled at once, about
PART = 1 << 13  # words keyed at once
ITEM_WORDS = 2_000_000  # of one block of items
PUNCTUATION = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def flat(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(PUNCTUATION).split())


def edits_allowed(m: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * m + 1e-9)


def sampled(words: np.ndarray, start: np.ndarray, steps: np.ndarray, seed: int) -> np.ndarray:
    """Key of the given steps (ascending) of the CGK walk from each start; words go on for as many steps.

    The walks from all words are keyed at once from their last step back, as the walk from a word at step t is that
    from it or from the next word at step t + 1: so neighbours are chosen from, in parts that stay in the cache.
    """
    last, mix = int(steps[-1]), np.uint64(kernels.MIX1)
    turn, taken = kernels.random_words(1, seed), {int(t) for t in steps}
    out = np.empty(max(0, len(words) - last), np.uint64)
    for lo in range(0, len(out), PART):
        w = words[lo : min(lo + PART, len(out)) + last]
        bits = kernels.mixed(w ^ turn)
        key = w * mix
        for t in range(last - 1, -1, -1):
            # Arithmetic instead of a branch: all ones where the bit is set.
            moves = bits[: len(key) - 1] >> np.uint64(t)
            moves &= np.uint64(1)
            np.negative(moves, out=moves)
            moves &= key[1:] ^ key[:-1]
            moves ^= key[:-1]
            key = moves
            if t in taken:
                key ^= w[: len(key)]
                key *= mix
        out[lo : lo + PART] = kernels.mixed(key)
    return out[start]


def best_edits(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """Fewest edits between item and any part of doc, and the end of the earliest such part."""
    n = len(doc)
    row, ramp = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, w in enumerate(item, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (doc != w), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp  # insertions from the left
    end = int(np.argmin(row))
    return int(row[end]), end


class Items:
    """A block of items: their words and the tables of their sampled walks."""

    def __init__(self, rows: list[tuple[int, str | None]], similarity: float, least: int, repeats: int, bits: int, steps: int):
        body = b"".join(flat(t) + b"\n" for _, t in rows)
        h, counts = kernels.word_hashes(body)
        keep = counts > 0
        start = np.cumsum(counts) - counts
        self.ids = [r[0] for r, k in zip(rows, keep, strict=True) if k]
        self.start, self.size = start[keep], counts[keep]
        self.edits = np.array([edits_allowed(int(m), similarity) if m >= least else 0 for m in self.size], np.int64)
        self.words = h
        # Short items have shorter walks, and those that match exactly need one table.
        walk = np.where(self.size >= steps, steps, np.where(self.edits > 0, least, np.minimum(self.size, least)))
        self.tables = []  # steps, seed, sieve, sorted keys, their items and offsets
        for length in np.unique(walk):
            of = np.flatnonzero(walk == length)
            spots = [np.unique(np.linspace(0, self.size[i] - length, OFFSETS).astype(np.int64)) if self.edits[i] else np.zeros(1, np.int64) for i in of]
            item, offset = np.repeat(of, [len(x) for x in spots]), np.concatenate(spots)
            n = min(bits, int(length)) if length >= steps or not self.edits[of].any() else min(bits, -(-int(length) // 2))
            for r in range(repeats if self.edits[of].any() else 1):
                seed = 1000 * int(length) + r
                sample = np.sort(np.argsort(kernels.random_words(int(length), seed), kind="stable")[:n])
                key = sampled(np.concatenate((h, np.zeros(int(length), np.uint64))), self.start[item] + offset, sample, seed)
                order = np.argsort(key, kind="stable")
                sieve = np.zeros(1 << 20, bool)
                sieve[key & np.uint64((1 << 20) - 1)] = True
                self.tables.append((sample, seed, sieve, key[order], item[order], offset[order]))

    def met(self, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (item, document, start) of windows that meet an item in any table."""
        pairs = [np.empty((0, 3), np.int64)]
        ramp = np.arange(len(words))
        for sample, seed, sieve, keys, item, offset in self.tables:
            key = sampled(np.concatenate((words, np.zeros(int(sample[-1]) + 1, np.uint64))), ramp, sample, seed)
            at = np.flatnonzero(sieve[key & np.uint64((1 << 20) - 1)])
            lo, hi = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            n = hi - lo
            k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            pairs.append(np.stack((item[k], doc[at], at - offset[k]), axis=1))
        return np.unique(np.concatenate(pairs), axis=0)

    def may_match(self, item: int, words: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which windows (of one item, in documents lo:hi) hold as many of its words as a match must."""
        m, e = int(self.size[item]), int(self.edits[item])
        own, times = np.unique(self.words[self.start[item] : self.start[item] + m], return_counts=True)
        out = np.zeros(len(start), bool)
        step = max(1, (1 << 20) // (m + 2 * e))
        for a in range(0, len(start), step):
            s = slice(a, a + step)
            at = start[s, None] + np.arange(-e, m + e)
            inside = (at >= lo[s, None]) & (at < hi[s, None])
            w = words[np.clip(at, 0, len(words) - 1)]
            spot = np.minimum(np.searchsorted(own, w), len(own) - 1)
            row, col = np.nonzero(inside & (own[spot] == w))
            seen = np.zeros((len(w), len(own)), bool)
            seen[row, spot[row, col]] = True
            out[s] = seen @ times >= m - e
        return out


def find(items: Items, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, edits, end) of each match in documents of counts[i] words each."""
    ends = np.cumsum(counts)
    begin = ends - counts
    met = items.met(words, np.repeat(np.arange(len(counts)), counts))
    out = []
    for a, b in kernels.spans(met[:, 0]):
        item = int(met[a, 0])
        d, start = met[a:b, 1], met[a:b, 2]
        m, e = int(items.size[item]), int(items.edits[item])
        own = items.words[items.start[item] : items.start[item] + m]
        good = items.may_match(item, words, start, begin[d], ends[d])
        d, start = d[good], start[good]
        # Windows of a document that overlap are verified as one.
        apart = np.cumsum(np.concatenate(([0], start[1:] - start[:-1] > m))) if len(d) else d
        best: dict[int, tuple[int, int]] = {}
        for i, j in kernels.spans(d, apart):
            doc = int(d[i])
            lo, hi = max(int(begin[doc]), int(start[i]) - e), min(int(ends[doc]), int(start[j - 1]) + m + e)
            edits, end = best_edits(own, words[lo:hi])
            if edits <= e:
                best[doc] = min(best.get(doc, (edits, lo + end)), (edits, lo + end))
        out += [(doc, item, edits, end - int(begin[doc])) for doc, (edits, end) in best.items()]
    return sorted(out)


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least: int = LEAST, repeats: int = REPEATS, bits: int = BITS, steps: int = STEPS, item_words: int = ITEM_WORDS) -> DataFrame:
    """doc_id, item_id, item_words, edits, start_word: one row for each document and item that it holds."""
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // (5 * item_words)))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, item_words long, edits long, start_word long"
    texts, out = docs.select("doc_id", "text"), None
    for k in range(n_blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).select("item_id", "text").collect()  # at most about item_words words
        items = Items([tuple(r) for r in rows], similarity, least, repeats, bits, steps)
        if not len(items.ids):
            continue
        part = texts.mapInArrow(_runner(shared(spark, items)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _runner(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = opened(held)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in kernels._runs(np.array([len(t or "") + 1 for t in texts], np.int64), SLICE):
                part = b.slice(lo, hi - lo)
                words, counts = kernels.word_hashes(b"".join(flat(t) + b"\n" for t in texts[lo:hi]))
                got = find(items, words, counts)
                if got:
                    ids = part.column(0).take(pa.array([g[0] for g in got]))
                    longs = [[items.ids[g[1]] for g in got], [int(items.size[g[1]]) for g in got], [g[2] for g in got], [max(0, g[3] - int(items.size[g[1]])) for g in got]]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in longs)], names=["doc_id", "item_id", "item_words", "edits", "start_word"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item. Rows with the doc_id of such a document go with it."""
    own = fresh("bad")
    bad = matches(docs, benchmark).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")
