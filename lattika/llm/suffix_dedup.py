"""Long repeated strings by a logarithmic family of sparse suffix arrays.

Suffixes are indexed at content-defined places: each string of `length` bytes
selects the smallest hash among its `seed`-byte strings, so equal strings select
the same place. The strings of one place are neighbours and form a run of bytes
around it. A run goes to the bucket of its seed's hash; equal runs of a block, and
then of a bucket, become one, compared byte for byte.

A bucket keeps a logarithmic family (`Family`). A batch of runs becomes a suffix
array: its places, sorted by the bytes that follow them. It is merged by a scan
with the array of every level of the family. In the merged order, neighbours of at
least `seed` common bytes are a group; within it, two strings at the same distance
before their places are equal if the bytes after the places agree (an interval of
this array) and the bytes before them do (an interval of the array of reversed
left contexts). Both are read from arrays of common prefix lengths, so hashes
route bytes and never decide. Then the batch joins the family, and levels of equal
rank merge geometrically.

`suffix_dedup` finds the repeats within one table; round 1 leaves out the places
whose seed no other place has. `extend` takes a batch into a family that is stored
as a table, and tells which strings of the batch and of earlier ones it repeats.

Defined results: null and empty texts have no bytes; texts shorter than `length`
lose nothing; repeated rows are documents of their own, so both lose what they
share; an empty table gives no rows; other columns are ignored. A document is read
whole, however long: its bytes, eight times over, must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.llm import blocks as B
from lattika.llm import kernels
from lattika.llm.common import by_value

by_value(__name__)

LENGTH, SEED = 200, 64
BATCH_RUNS = 1 << 16


class Bytes:
    """A block's bytes, documents end to end, and the starts of strings that lie in one document."""

    def __init__(self, row: dict, length: int):
        import zstandard

        self.buf = np.frombuffer(zstandard.decompress(row["body"]), np.uint8)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        edge = np.zeros(len(self.buf) + 1, np.int32)
        some = self.sizes >= length
        np.add.at(edge, (self.ends - self.sizes)[some], 1)
        np.add.at(edge, self.ends[some] - length + 1, -1)
        self.starts = np.flatnonzero(np.cumsum(edge[:-1]))

    def places(self, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Seed hashes (63 bits), and for each start the place it selects."""
        h = kernels.rolling(kernels.random_words(256, 7)[self.buf], seed) >> np.uint64(1) << np.uint64(1)
        return h, kernels.window_min(h, length - seed + 1)[self.starts]


def ask_places(row: dict, length: int, seed: int, n: int) -> Iterator[tuple[int, bytes]]:
    b = Bytes(row, length)
    h, place = b.places(length, seed)
    values, several = B.distinct(h[(at := np.unique(place))], at)
    values = B.flagged(values, several)
    for bucket, at in B.by_bucket(values, n):
        yield bucket, B.squeeze(values[at])


def _collapse(fp: np.ndarray, buf: np.ndarray, off: np.ndarray, size: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """For each run the first one with the same bytes and place; fp only brings equal runs together."""
    order = np.lexsort((ahead, size, fp))
    f, s, a = fp[order], size[order], ahead[order]
    again = np.concatenate(([False], (f[1:] == f[:-1]) & (s[1:] == s[:-1]) & (a[1:] == a[:-1]))) if len(order) else np.empty(0, bool)
    at = np.flatnonzero(again)
    again[at] = kernels.same_bytes(buf, off[order[at]], buf, off[order[at - 1]], size[order[at]])
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    out = np.empty(len(order), np.int64)
    out[order] = order[first]
    return out


def ask_runs(row: dict, length: int, seed: int, n: int, every: bool = False) -> Iterator[tuple[int, bytes]]:
    """Runs of strings with one place: bytes before the place, strings, copies, first starts of all copies, bytes."""
    known = B.gathered(row.get("marks"))
    if not every and not len(known):
        return
    b = Bytes(row, length)
    h, place = b.places(length, seed)
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (b.starts[1:] != b.starts[:-1] + 1)))) if len(place) else place
    count = np.diff(np.concatenate((new, [len(place)])))
    first, at = b.starts[new], place[new]
    if not every:
        alive = B.member(h[at] >> np.uint64(1), known)
        first, count, at = first[alive], count[alive], at[alive]
    size, ahead = count + length - 1, at - first
    sums = kernels.prefix_sums(kernels.random_words(256, 7)[b.buf])
    same = _collapse(kernels.between(sums, first, first + size), b.buf, first, size, ahead)
    order = np.argsort(same, kind="stable")  # copies side by side
    lead, copies = np.unique(same, return_counts=True)
    begin = np.cumsum(copies) - copies
    for bucket, k in B.by_bucket(h[at[lead]], n):
        run, c = lead[k], copies[k]
        owners = first[order[np.repeat(begin[k], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]]
        z = size[run]
        body = b.buf[np.repeat(first[run], z) + np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)]
        yield bucket, B.squeeze(np.concatenate([x.astype(np.int64).view(np.uint8) for x in (np.array([len(run), c.sum()]), ahead[run], count[run], c, owners)] + [body]))


class Runs:
    """Distinct runs of some blobs, and the places of all their copies."""

    def __init__(self, names: list[int], blobs: list[bytes], length: int):
        parts = []
        for name, blob in zip(names, blobs, strict=True):
            raw = B.loosen(blob, np.uint8)
            n, m = (int(x) for x in raw[:16].view(np.int64))
            ints = raw[16 : 16 + 8 * (3 * n + m)].view(np.int64)
            body = raw[16 + 8 * (3 * n + m) :]
            size = ints[n : 2 * n] + length - 1
            stop = np.cumsum(size)
            fp = kernels.between(kernels.prefix_sums(kernels.random_words(256, 7)[body]), stop - size, stop)
            parts.append((ints[:n], ints[n : 2 * n], ints[2 * n : 3 * n], ints[3 * n :], np.full(m, name), fp, body))
        ahead, count, copies, self.first, self.block, fp, body = (np.concatenate(x) for x in zip(*parts, strict=True))
        body = np.concatenate((body, np.zeros(length, np.uint8)))
        size = count + length - 1
        off = np.cumsum(size) - size
        lead, which = np.unique(_collapse(fp, body, off, size, ahead), return_inverse=True)
        self.run = np.repeat(which, copies)  # of each copy
        self.copies = np.bincount(self.run, minlength=len(lead))
        self.ahead, self.count = ahead[lead], count[lead]
        self.low = self.ahead - self.count + 1  # the strings of a run start low..ahead bytes before its place
        self._body, self._off, self.length = body, off[lead], length
        self.owner = np.full(len(lead), -1, np.int64)  # a copy of each run, for the family
        self.owner[self.run[::-1]] = np.arange(len(self.run))[::-1]

    def context(self, at: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after the place and reversed bytes before it, zero outside of the run: sortable byte strings."""
        before = self.length - seed
        place = self._off[at] + self.ahead[at]
        view = np.lib.stride_tricks.sliding_window_view
        right = view(self._body, self.length)[place]
        right[np.arange(self.length) >= (self.length - self.low[at])[:, None]] = 0
        back = np.concatenate((self._body[::-1], np.zeros(before, np.uint8)))
        left = view(back, before)[len(self._body) - place]
        left[np.arange(before) >= self.ahead[at][:, None]] = 0
        return right, left


def _common(rows: np.ndarray) -> np.ndarray:
    """Common prefix length of each row and the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), 1 << 14):
        hi = min(len(rows), lo + (1 << 14))
        differ = rows[lo:hi] != rows[lo - 1 : hi - 1]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _text(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


class Family:
    """Levels of suffix arrays: right and left contexts, extent and owner of each place, in the order of the right ones."""

    def __init__(self, length: int, seed: int, levels: list[dict] | None = None):
        self.length, self.seed, self.levels = length, seed, levels or []

    def add(self, runs: Runs, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Takes the runs at `at` in; (block, first, count) of strings now known to repeat, in the batch and in the family."""
        right, left = runs.context(at, self.seed)
        order = np.argsort(_text(right), kind="stable")
        at = at[order]
        new = {"rank": 0, "right": right[order], "left": left[order], "low": runs.low[at], "high": runs.ahead[at], "block": runs.block[runs.owner[at]], "first": runs.first[runs.owner[at]]}
        out = [self._matches(new, None)]
        for level in self.levels:
            out.append(self._matches(self._merged(level, new), np.concatenate((np.zeros(len(level["low"]), bool), np.ones(len(at), bool)))[self._turns(level, new)]))
        self.levels.append(new)
        while len(self.levels) > 1 and self.levels[-1]["rank"] == self.levels[-2]["rank"]:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merged(a, b) | {"rank": a["rank"] + 1})
        return out

    @staticmethod
    def _turns(a: dict, b: dict) -> np.ndarray:
        """Merge scan: the order that merges a's rows, followed by b's."""
        n, m = len(a["low"]), len(b["low"])
        spot = np.searchsorted(_text(a["right"]), _text(b["right"]), "right") if n and m else np.zeros(m, np.int64)
        place = np.empty(n + m, np.int64)
        of_b = spot + np.arange(m)
        rest = np.ones(n + m, bool)
        rest[of_b] = False
        place[of_b], place[rest] = n + np.arange(m), np.arange(n)
        return place

    def _merged(self, a: dict, b: dict) -> dict:
        turns = self._turns(a, b)
        return {k: np.concatenate((a[k], b[k]))[turns] for k in a if k != "rank"}

    def _matches(self, x: dict, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strings of the sorted rows x that another row has too; with side, only groups of both sides are looked at."""
        group = np.cumsum(_common(x["right"]) < self.seed) if len(x["low"]) else np.empty(0, np.int64)
        size = np.bincount(group)
        wanted = size > 1
        if side is not None:
            new = np.bincount(group, side, len(size))
            wanted = (new > 0) & (new < size)
        keep = np.flatnonzero(wanted[group])
        n, hits = len(keep), np.zeros((len(keep), self.length - self.seed + 1), bool)
        if not n:
            return (np.empty(0, np.int64),) * 3
        low, high = x["low"][keep], x["high"][keep]
        after = _common(x["right"][keep])
        by_left = np.argsort(_text(x["left"][keep]), kind="stable")
        before = _common(x["left"][keep][by_left])
        spot = np.empty(n, np.int64)
        spot[by_left] = np.arange(n)
        ramp = np.arange(n)
        for a in range(self.length - self.seed + 1):
            members = np.flatnonzero((low <= a) & (a <= high))
            if len(members) < 2:
                continue
            r = np.maximum.accumulate(np.where(after < self.length - a, ramp, 0))[members]
            l = np.maximum.accumulate(np.where(before < a, ramp, 0))[spot[members]]
            key = r * n + l
            order = np.argsort(key, kind="stable")
            key = key[order]
            same = key[1:] == key[:-1]
            both = np.zeros(len(members), bool)
            both[1:] |= same
            both[:-1] |= same
            hits[members[order[both]], a] = True
        # A string a bytes before its place starts at first + high - a.
        edge = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, lo = np.nonzero(edge == 1)
        hi = np.nonzero(edge == -1)[1]
        return x["block"][keep][row], x["first"][keep][row] + high[row] - hi + 1, hi - lo

    def dump(self) -> bytes:
        import pickle

        import zstandard

        return zstandard.compress(pickle.dumps(self.levels), 1)

    @staticmethod
    def load(blob: bytes, length: int, seed: int) -> Family:
        import pickle

        import zstandard

        return Family(length, seed, pickle.loads(zstandard.decompress(blob)))


def _repeats(family: Family, names: list[int], blobs: list[bytes], length: int, batch: int) -> dict[int, bytes]:
    """To each block its runs (first, count) of repeated strings, after the blobs' runs went into the family."""
    runs = Runs(names, blobs, length)
    # Copies of a run repeat as a whole.
    many = runs.copies[runs.run] > 1
    found = [(runs.block[many], runs.first[many], runs.count[runs.run[many]])]
    n = len(runs.low)
    for lo in range(0, n, batch):
        found += family.add(runs, np.arange(lo, min(n, lo + batch)))
    # The copies of a run that repeats in part repeat in whole already, so its owner stands for itself alone.
    block, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((count, first, block))
    block, marks = block[order], np.stack((first[order], count[order]), axis=1)
    return {int(block[lo]): B.squeeze(np.unique(marks[lo:hi], axis=0)) for lo, hi in kernels.spans(block)}


def reply_matches(length: int, seed: int, batch: int):
    def reply(names: list[int], blobs: list[bytes]) -> dict[int, bytes]:
        return _repeats(Family(length, seed), names, blobs, length, batch)

    return reply


def remove(row: dict, length: int, with_text: bool) -> Iterator[tuple]:
    b = Bytes(row, length)
    edge = np.zeros(len(b.buf) + 1, np.int64)
    for m in row["marks"] or []:
        runs = B.loosen(m, np.int64).reshape(-1, 2)
        np.add.at(edge, runs[:, 0], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1] + length - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    opens = gone & ~np.concatenate(([False], gone[:-1]))
    begin = b.ends - b.sizes
    opens[begin[b.sizes > 0]] = gone[begin[b.sizes > 0]]  # runs end with their document
    total, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(opens)))
    for i, (lo, hi) in enumerate(zip(begin, b.ends, strict=True)):
        kept = b.buf[lo:hi][~gone[lo:hi]].tobytes()
        yield row["ids"][i], int(hi - lo), int(total[hi] - total[lo]), int(spans[hi] - spans[lo]), hashlib.sha256(kept).hexdigest(), kept if with_text else None


def _removed(packed: DataFrame, hits: DataFrame, length: int, with_text: bool) -> DataFrame:
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches):
        for b in batches:
            for row in B.rows_of(b):
                cols = list(zip(*remove(row, length, with_text), strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    out = B.with_marks(packed, hits).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = True, block_bytes: int = B.BLOCK_BYTES, batch_runs: int = BATCH_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes: one row per row of docs."""
    packed = B.pack(docs, False, block_bytes)
    n = B.n_buckets(packed)
    seeds = B.answer(B.ask(packed, lambda row: ask_places(row, length, seed, n)), B.reply_repeated)
    hits = B.answer(B.ask(B.with_marks(packed, seeds), lambda row: ask_runs(row, length, seed, n)), reply_matches(length, seed, batch_runs))
    return _removed(packed, hits, length, with_text)


FAMILY = "bucket int, family binary"


def extend(family: DataFrame | None, packed: DataFrame, n: int, length: int = LENGTH, seed: int = SEED, batch_runs: int = BATCH_RUNS) -> DataFrame:
    """A stored family (FAMILY, in n buckets; None: a new one) after a batch of packed blocks went in.

    bucket, family, and marks: array of (block, blob) of strings that the batch showed to repeat, in its
    own blocks and in those of earlier batches.
    """
    spark = packed.sparkSession
    asked = B.ask(packed, lambda row: ask_runs(row, length, seed, n, every=True))
    old = family.select("bucket", "family") if family is not None else spark.createDataFrame([], FAMILY)

    def run(new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        own = Family.load(known["family"].iloc[0], length, seed) if len(known) else Family(length, seed)
        found = _repeats(own, new["block"].tolist(), new["blob"].tolist(), length, batch_runs) if len(new) else {}
        bucket = int((new if len(new) else known)["bucket"].iloc[0])
        return pd.DataFrame({"bucket": [bucket], "family": [own.dump()], "marks": [[{"block": k, "blob": v} for k, v in found.items()]]})

    return asked.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInPandas(run, f"{FAMILY}, marks array<struct<block:long,blob:binary>>")


def removed(packed: DataFrame, families: list[DataFrame], length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """Like suffix_dedup, of packed blocks, by the marks of all batches that went into a family so far."""
    marks = None
    for f in families:
        m = f.select(F.explode("marks").alias("m")).select("m.block", "m.blob")
        marks = m if marks is None else marks.unionByName(m)
    return _removed(packed, marks.groupBy("block").agg(F.collect_list("blob").alias("marks")), length, with_text)
