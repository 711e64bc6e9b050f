"""Documents packed into compressed blocks, and rounds of questions between blocks and buckets.

A block is one row: ids, sizes and the compressed texts of neighbouring documents.
Blocks are written once to the shared checkpoint folder; each round, a block asks
the buckets of a hash space about its own distinct hashes, packed into one blob a
bucket, and gets blobs back. So rows of shuffles are few, nothing is held for a
position, and a hash that most documents share counts once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.llm.common import by_value, cut

by_value(__name__)

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 32 << 20  # text for each bucket, about
SCHEMA = "block long, ids array<bigint>, sizes binary, body binary, n_bytes long"


def pack(docs: DataFrame, as_words: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of docs (doc_id, text): raw UTF-8, or words joined by one space and documents by a line break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import secrets

        import zstandard

        ids, texts, total = [], [], 0

        def block() -> pa.RecordBatch:
            body = b"".join(t + b"\n" for t in texts) if as_words else b"".join(texts)
            sizes = np.array([len(t) for t in texts], np.int64).tobytes()
            # The name is drawn once: blocks are read from the checkpoint only.
            row = {"block": [secrets.randbits(62)], "ids": [ids], "sizes": [sizes], "body": [zstandard.compress(body, 3)], "n_bytes": [len(body)]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("body", pa.binary()), ("n_bytes", pa.int64())]))

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                raw = b" ".join(raw.split()) if as_words else raw
                if texts and total + len(raw) > block_bytes:
                    yield block()
                    ids, texts, total = [], [], 0
                ids.append(i)
                texts.append(raw)
                total += len(raw) + 1
        if texts:
            yield block()

    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA))


def n_buckets(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def squeeze(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def loosen(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(blob), kind)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row of Python values at a time; binary columns stay small views until asked for."""
    for i in range(batch.num_rows):
        yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def ask(blocks: DataFrame, emit: Callable[[dict], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(bucket, block, blob) of what each block emits."""
    kinds = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                got = list(emit(row))
                yield pa.RecordBatch.from_pydict({"bucket": [g[0] for g in got], "block": [row["block"]] * len(got), "blob": [g[1] for g in got]}, schema=kinds)

    return blocks.mapInArrow(run, "bucket int, block long, blob binary")


def answer(asked: DataFrame, reply: Callable[[list[int], list[bytes]], dict[int, bytes]]) -> DataFrame:
    """(block, marks): the replies of all buckets to each block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = reply(pdf["block"].tolist(), pdf["blob"].tolist())
        return pd.DataFrame({"block": pd.Series(list(out), dtype="int64"), "blob": pd.Series(list(out.values()), dtype="object")})

    replies = asked.groupBy("bucket").applyInPandas(run, "block long, blob binary")
    return replies.groupBy("block").agg(F.collect_list("blob").alias("marks"))


def with_marks(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    return blocks.join(marks, "block", "left")


def by_bucket(h: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket and the indices of h in it, for buckets that have any."""
    if not len(h):
        return
    bucket = ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(bucket[order[lo]]), order[lo:hi]


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of h and whether more than one owner (h and owner at the same index) has each."""
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    last = np.concatenate((first[1:], [len(h)])) - 1 if len(h) else first
    return h[first], owner[first] != owner[last]


def flagged(h: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Hashes whose lowest bit holds the flag."""
    return (h & ~np.uint64(1)) | flags.astype(np.uint64)


def reply_repeated(names: list[int], blobs: list[bytes]) -> dict[int, bytes]:
    """To each block those of its flagged hashes that another block has as well, or whose flag is set."""
    parts = [loosen(b, np.uint64) for b in blobs]
    every = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    seen, counts = np.unique(every >> np.uint64(1), return_counts=True)
    again = np.zeros(len(seen), bool)
    again |= counts > 1
    np.logical_or.at(again, np.searchsorted(seen, every >> np.uint64(1)), (every & np.uint64(1)).astype(bool))
    out: dict[int, list[np.ndarray]] = {}
    for name, part in zip(names, parts, strict=True):
        hit = again[np.searchsorted(seen, part >> np.uint64(1))]
        if hit.any():
            out.setdefault(name, []).append(part[hit] >> np.uint64(1))
    return {k: squeeze(np.concatenate(v)) for k, v in out.items()}


def gathered(marks: list[bytes] | None, kind=np.uint64) -> np.ndarray:
    return np.sort(np.concatenate([loosen(m, kind) for m in marks])) if marks else np.empty(0, kind)


def member(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are in sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return values[at] == x
