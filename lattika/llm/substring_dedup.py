"""Substring dedup by level-wise doubling of word windows.

The first level looks at windows of `first` words, at the places that every target
window is sure to hold one of (the smallest hash among its windows of that size).
Those that another document has too survive, and are extended to twice the length:
to the right where the target window allows it, else to the left. This goes on until
no candidate survives or the target length is reached, where windows are looked up
with the smallest doc_id they start in. A target window that repeats repeats at every
level, so none is lost, and windows of unique text leave at the first levels.

Words have XXH64 hashes; fingerprints of windows are 63 and 64 bits of a polynomial in
them. Two unlike windows are taken for equal with a chance of 2**-64 for each pair of
those whose every level repeats.

Defined results: null, empty and blank texts have no words; texts shorter than the
target lose nothing; a null doc_id counts as the largest; rows that repeat a doc_id
are copies of one document and remove nothing of each other; an empty table gives
no rows; other columns are ignored. A document is read whole, however long: its
text, some ten times over, must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.llm import blocks as B
from lattika.llm import kernels
from lattika.llm.common import by_value, cut

by_value(__name__)

TARGET, FIRST = 13, 4
NONE = np.iinfo(np.int64).max


class Words:
    """A block's words: hashes, the owner of each and the starts of target windows."""

    def __init__(self, row: dict, target: int):
        import zstandard

        self.body = zstandard.decompress(row["body"])
        self.ids = np.array([NONE if i is None else i for i in row["ids"]], np.int64)
        self.h, self.counts = kernels.word_hashes(self.body)
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)
        n = max(0, len(self.h) - target + 1)
        self.starts = np.flatnonzero(self.doc[:n] == self.doc[target - 1 : target - 1 + n])
        self.target = target

    def alive(self, lengths: list[int], marks: list[list[bytes] | None]) -> tuple[np.ndarray, np.ndarray]:
        """Starts of target windows that survived the levels that `marks` answers, and the place of each at the next one."""
        starts, place = self.starts, None
        for k, size in enumerate(lengths[: len(marks) + 1]):
            h = kernels.rolling(self.h, size)
            if place is None:
                place = kernels.window_min(h, self.target - size + 1)[starts]
            else:
                left = place + lengths[k - 1] - size
                last = starts + self.target - size
                place = np.where(place <= last, place, np.where(left >= starts, left, last))
            if k == len(marks):
                break
            keep = B.member(h[place] >> np.uint64(1), B.gathered(marks[k]))
            starts, place = starts[keep], place[keep]
        return starts, place

    def windows(self) -> np.ndarray:
        return kernels.rolling(self.h, self.target)[self.starts]


def levels(target: int, first: int) -> list[int]:
    """Doubled lengths below the target."""
    out, n = [], max(1, first)
    while n < target:
        out.append(n)
        n *= 2
    return out


def ask_level(row: dict, target: int, lengths: list[int], k: int, n: int) -> Iterator[tuple[int, bytes]]:
    """Hashes of the windows of lengths[k] words that extend the survivors of the levels before."""
    marks = [row[f"m{i}"] for i in range(k)]
    if any(not m for m in marks):
        return
    w = Words(row, target)
    _, place = w.alive(lengths, marks)
    place = np.unique(place)
    values, several = B.distinct(kernels.rolling(w.h, lengths[k])[place] >> np.uint64(1) << np.uint64(1), w.ids[w.doc[place]])
    values = B.flagged(values, several)
    for bucket, at in B.by_bucket(values, n):
        yield bucket, B.squeeze(values[at])


def ask_windows(row: dict, target: int, lengths: list[int], n: int) -> Iterator[tuple[int, bytes]]:
    marks = [row[f"m{i}"] for i in range(len(lengths))]
    if any(not m for m in marks):
        return
    w = Words(row, target)
    starts, _ = w.alive(lengths, marks)
    values, owner = kernels.rolling(w.h, target)[starts], w.ids[w.doc[starts]]
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else order
    values, owner = values[first], owner[first]  # the smallest doc_id of the block
    for bucket, at in B.by_bucket(values, n):
        at = at[np.argsort(owner[at], kind="stable")]
        steps = np.diff(owner[at], prepend=0).view(np.uint8).reshape(-1, 8).T
        yield bucket, np.int64(len(at)).tobytes() + values[at].tobytes() + B.squeeze(steps)


def reply_later(names: list[int], blobs: list[bytes]) -> dict[int, bytes]:
    """To each block those of its windows that start in a smaller document elsewhere."""
    parts = []
    for b in blobs:
        n = int(np.frombuffer(b[:8], np.int64)[0])
        steps = B.loosen(b[8 + 8 * n :], np.uint8).reshape(8, n).T
        parts.append((np.frombuffer(b[8 : 8 + 8 * n], np.uint64), np.cumsum(np.ascontiguousarray(steps).view(np.int64).ravel())))
    values, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    least = np.full(len(values), NONE, np.int64)
    np.minimum.at(least, place, np.concatenate([p[1] for p in parts]))
    out: dict[int, list[np.ndarray]] = {}
    for name, (v, ids) in zip(names, parts, strict=True):
        later = least[np.searchsorted(values, v)] < ids
        if later.any():
            out.setdefault(name, []).append(v[later])
    return {k: B.squeeze(np.concatenate(v)) for k, v in out.items()}


def remove(row: dict, target: int, with_text: bool) -> Iterator[tuple]:
    w = Words(row, target)
    values, owner = w.windows(), w.ids[w.doc[w.starts]]
    gone = B.member(values, B.gathered(row["marks"]))
    seen, place = np.unique(values, return_inverse=True)
    least = np.full(len(seen), NONE, np.int64)
    np.minimum.at(least, place, owner)
    gone |= least[place] < owner
    edge = np.zeros(len(w.h) + 1, np.int64)
    np.add.at(edge, w.starts[gone], 1)
    np.add.at(edge, w.starts[gone] + target, -1)
    dropped = np.cumsum(edge[:-1]) > 0
    # One separator follows each word, and an empty document is a separator alone.
    buf = np.frombuffer(w.body, np.uint8)
    stop = np.flatnonzero((buf == 32) | (buf == 10))
    size = np.diff(stop, prepend=-1)
    keep_word = np.zeros(len(stop), bool)
    keep_word[size > 1] = ~dropped
    mask = np.repeat(keep_word, size)
    kept = buf[mask].tobytes()
    ends = np.cumsum(np.add.reduceat(mask, np.concatenate(([0], np.flatnonzero(buf == 10)[:-1] + 1))).astype(np.int64)) if len(buf) else []
    taken = np.zeros(len(w.ids), np.int64)
    np.add.at(taken, w.doc[dropped], 1)
    lo = 0
    for i, hi in enumerate(ends):
        text = kept[lo : max(lo, int(hi) - 1)]
        yield row["ids"][i], int(w.counts[i]), int(taken[i]), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None
        lo = int(hi)


def substring_dedup(docs: DataFrame, target: int = TARGET, first: int = FIRST, with_text: bool = True, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words: one row per row of docs."""
    packed = B.pack(docs, True, block_bytes)
    n = B.n_buckets(packed)
    lengths, asked = levels(target, first), packed
    for k in range(len(lengths)):
        survivors = cut(B.answer(B.ask(asked, lambda row, k=k: ask_level(row, target, lengths, k, n)), B.reply_repeated), release=True)
        asked = B.with_marks(asked, survivors.withColumnRenamed("marks", f"m{k}"))
        if survivors.isEmpty():
            break
    if len(asked.columns) < len(packed.columns) + len(lengths):
        later = packed.select("block").limit(0).withColumn("marks", F.array().cast("array<binary>"))
    else:
        later = B.answer(B.ask(asked, lambda row: ask_windows(row, target, lengths, n)), reply_later)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches):
        for b in batches:
            for row in B.rows_of(b):
                cols = list(zip(*remove(row, target, with_text), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    out = B.with_marks(packed, later).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")
