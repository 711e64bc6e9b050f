"""Suffix arrays: batches, stored families, hostile bytes."""

import random

import brute
import numpy as np
from test_free import corpus, frame

from lattika.llm import blocks, kernels, suffix_dedup


def hostile():
    """Shared passages at several offsets, one inside another, runs of one byte, zero bytes, copies, a text over one block."""
    rng = random.Random(9)
    rand = lambda k: "".join(rng.choice("ab\0é") for _ in range(k))
    p, q = rand(230), rand(400)
    texts = ["a" * 900, "a" * 450 + "b" + "a" * 300, "\0" * 500, q, q, q[:260], rand(50) + q[100:330] + rand(50), rand(9000) + p + rand(300) + q]
    for i in range(30):
        texts.append(rand(rng.randint(0, 90)) + p[rng.randint(0, 20) : 230 - rng.randint(0, 20)] + (p if i % 4 == 0 else "") + rand(rng.randint(0, 90)))
    return list(enumerate(texts))


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def want(rows):
    return sorted((d, *x) for (d, _), x in zip(rows, brute.byte_repeats([t for _, t in rows]), strict=True))


def test_hostile_bytes_in_small_batches(spark):
    rows = hostile()
    for batch in (3, 1 << 16):
        assert result(suffix_dedup.suffix_dedup(frame(spark, rows), block_bytes=2000, batch_runs=batch)) == want(rows)


def test_repeated_rows(spark):
    rows = [(1, "x" * 10 + "".join(chr(97 + i * i % 23) for i in range(400)))] * 2 + [(None, "short")]
    got = suffix_dedup.suffix_dedup(frame(spark, rows)).collect()
    assert [r.n_removed for r in got if r.doc_id == 1] == [410, 410]


def test_batches_into_a_stored_family(spark, tmp_path):
    """Three batches, each into the family that the one before left on disk; marks reach earlier batches."""
    rows = [(d, t) for d, t in corpus(21)] + [(100 + d, t) for d, t in hostile()]
    parts, packs, states = [rows[k::3] for k in range(3)], [], []
    for k, part in enumerate(parts):
        packs.append(blocks.pack(frame(spark, part), False, 3000))
        old = spark.read.parquet(f"{tmp_path}/{k - 1}") if k else None
        suffix_dedup.extend(old, packs[-1], 5, batch_runs=50).write.parquet(f"{tmp_path}/{k}")
        states.append(spark.read.parquet(f"{tmp_path}/{k}"))
    every = packs[0].unionByName(packs[1]).unionByName(packs[2])
    assert result(suffix_dedup.removed(every, states)) == want(sorted(rows, key=lambda r: r[0]))


def test_slices_of_window_min(monkeypatch):
    h = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    whole = kernels.window_min(h, 137)
    monkeypatch.setattr(kernels, "WINDOW_BITS", 11)
    assert (kernels.window_min(h, 137) == whole).mean() > 0.999
