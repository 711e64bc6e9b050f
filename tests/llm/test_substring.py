"""Doubling levels, hostile words, odd tables."""

import random

import brute
from test_free import corpus, frame

from lattika.llm import substring_dedup


def result(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_words_that_collide_in_polynomials(spark):
    """Two unlike words of 1,024 letters in the doubling-complement order, before the same 12 words: no window repeats."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    got = substring_dedup.substring_dedup(frame(spark, [(1, f"{a} {rest}"), (2, a.translate(str.maketrans("ab", "ba")) + " " + rest)])).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_levels_and_lengths(spark):
    assert substring_dedup.levels(13, 4) == [4, 8] and substring_dedup.levels(13, 1) == [1, 2, 4, 8] and substring_dedup.levels(3, 7) == []
    rows = corpus(8, 25)
    for target, first in ((13, 1), (6, 2), (20, 3), (1, 1)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(frame(spark, rows), target, first, block_bytes=2000).collect()}
        assert got == brute.word_repeats(rows, target)


def test_nothing_survives_and_odd_tables(spark):
    rng = random.Random(4)
    rows = [(d, " ".join(str(rng.random()) for _ in range(40))) for d in range(5)]
    assert [r.n_removed for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()] == [0] * 5
    assert substring_dedup.substring_dedup(frame(spark, rows).limit(0)).count() == 0
    twice = [*rows, rows[0], (9, rows[0][1]), (None, rows[0][1]), (10, " ".join([rows[0][1]] * 300))]
    got = result(substring_dedup.substring_dedup(frame(spark, twice), block_bytes=3000))
    assert [g[2] for g in got] == [0] * 6 + [40, 12000, 40]
