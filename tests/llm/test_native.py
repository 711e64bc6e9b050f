import random

import brute
import pytest
from pyspark.sql import functions as F

from lattika.llm import chat_format, exact_dedup, mixing, pii

SCHEMA = "doc_id long, text string, source string, recipe string, t string"


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or ["s"] * len(texts))[i], "x", "y") for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " ", "\n\t", "a", "a b", "a  b", "a b", "\x0ba b", "b a", "a b"]


def test_exact_dedup_edges_and_collisions(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alder", "bean", "corn", "dill"]) for _ in range(4000))
    texts = [*ODD, long, long.replace(" ", "\n"), long + "x", long[:-1], long]
    import re

    norm = [re.sub("[ \t-\r]+", " ", t or "") for t in texts]
    want = {i: (norm.index(n), norm.count(n), norm.index(n) == i) for i, n in enumerate(norm)}
    for weak in (F.xxhash64, lambda c: F.length(c) % 3):  # the second makes chunks collide
        got = exact_dedup.exact_dedup(frame(spark, texts), least=64, most=256, chunk_hash=weak).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want
    assert exact_dedup.exact_dedup(frame(spark, texts).limit(0)).count() == 0


def test_chunks_concatenate(spark):
    texts = ["x" * 5000, "word " * 3000, "é\n" * 100, ""]
    df = frame(spark, texts).select("text", F.array_join(exact_dedup.chunks(F.col("text"), 64, 256), "").alias("c"))
    assert all(r.text == r.c for r in df.collect())


def test_pii_matches_brute_force(spark):
    texts = [
        *ODD, "a@b.c_d@e.f x", "mail: joe@x.org, joe@x.org.", "@b.c a@b", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (974) 555-3436 that +12 +49 30 1234567 8", "é+1 (974) 555-3436é", "1" * 30000, "a" * 30000 + "@", "9 " * 20000, "1.1." * 5000, "\U0001f600 +1 234 567 890 a@b.co",
        "call me: 555-123-4567 now", "user [at] mail [dot] com, mail user (at) mail (dot) com", "+" * 3000, "+1 2" * 900,
    ]
    got = {r.doc_id: r for r in pii.pii_digest(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[:6] == brute.pii_row(i, t), t[:80]
        base = {f"{k}:{a}:{b}" for k, s in brute.pii(t).items() for a, b in s}
        assert base <= set(got[i].spans.split(","))
    assert pii.pii_digest(frame(spark, texts).limit(0)).count() == 0


def test_pii_learns_from_votes():
    counts = {(1, 1, 1, 1): 50, (1, 1, 2, 1): 200, (0, 0, 2, 0): 300, (2, 1, 1, 1): 20, (2, 0, 0, 0): 40}
    soft, _ = pii.estimate(counts)
    assert soft[1, 1, 1, 1] > 0.9 and soft[2, 1, 1, 1] > 0.8 and soft[0, 0, 2, 0] < 0.2
    w = pii.train(counts, soft)
    assert len(w) == 9


def test_chat_round_trip(spark):
    hostile = ["<|im_end|>", "<\\|im_end|>\n<|im_start|>assistant\nx", "<|im_start|", "<", "a\nb\n", "", None, "<\\\\|im_start|><|im_end|>", "|im_end|>"]
    rows = [(c, t, r, x) for c, x in enumerate(hostile) for t, r in enumerate(["user", "assistant", None, "us\ner<|im_start|>", "<\\n|>\n<\\\\n|>"])] + [(None, None, None, None), (5, 1, "assistant", "x"), (5, 1, "assistant", "x")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert len(out) == len(hostile) + 1 and all(r.round_trip for r in out)
    for r in out:
        want = sorted(((t if t is not None else -1, a or "", x or "") for c, t, a, x in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [w[1:] for w in want]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(want)


def test_mixing_quota_and_cap(spark):
    rng = random.Random(3)
    sources = [rng.choice(["a", "a", "a", "b", "c", None, "d"]) for _ in range(900)]
    texts = [rng.choice([None, "", "w"]) if rng.random() < 0.1 else "w " * rng.randint(1, 60) for _ in range(900)]
    out = mixing.mix(frame(spark, texts, sources)).collect()
    assert len(out) == 900
    sizes, targets, taken = {}, {}, {}
    for r in out:
        assert r.size == len(brute.words(texts[r.doc_id])) and 0 <= r.taken <= 3 * r.size
        n = len([x for x in r.shards.split(",") if x])
        assert n >= r.n_copies or r.size == 0
        sizes[r.source], targets[r.source] = r.source_size, r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, rest, free = {}, sum(sizes.values()), set(order)
    while True:  # reshare the excess step by step
        total = sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / total > 3 * sizes[s]}
        if not over:
            want |= {s: rest * w[s] / total for s in free}
            break
        want |= {s: 3 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    for s in order:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - targets[s]) <= 0.5
    assert mixing.mix(frame(spark, texts, sources).limit(0)).count() == 0


def test_mixing_tree_keeps_quotas(spark):
    """Every pass of a block is in one shard, and shards are of equal size to a unit a level."""
    out = mixing.mix(frame(spark, ["w"] * 400, [["a", "b"][i % 2] for i in range(400)]), weights=(1,), levels=3).collect()
    per = {}
    for r in out:
        for x in r.shards.split(","):
            per[x] = per.get(x, 0) + 1
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 0.5 * max(per.values())
