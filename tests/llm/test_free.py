import random

import brute
import numpy as np
import xxhash

from lattika.llm import decontaminate, kernels, langid, line_dedup, simhash, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, block string, marks string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)


def corpus(seed=1, n=40):
    """Copies, near copies, shared passages, odd texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, texts = make(70), [None, "", " \n ", "a", "a b", "é" * 300]
    for i in range(n):
        t = make(rng.randint(1, 120))
        if i % 3 == 0:
            t = t + "\n" + passage + " " + make(5)
        if i % 5 == 0 and texts[-1]:
            t = texts[-1] + (" x" if i % 2 else "")
        texts.append(t)
    return list(enumerate(texts))


def test_kernels():
    rng = np.random.default_rng(0)
    buf = np.concatenate((rng.integers(0, 256, 2000).astype(np.uint8), np.zeros(8, np.uint8)))
    off, size = rng.integers(0, 1000, 200), rng.integers(0, 200, 200)
    got = kernels.xxh64(buf, off, size)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(buf[o : o + s].tobytes(), 42) for o, s in zip(off, size, strict=True)]
    h = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    assert [h[i] for i in kernels.window_min(h, 7)] == [h[i : i + 7].min() for i in range(494)]
    values = rng.integers(0, 3, 300).astype(np.uint64)
    roll = kernels.rolling(values, 5)
    pairs = {}
    for i, r in enumerate(roll):
        assert pairs.setdefault(tuple(values[i : i + 5]), r) == r
    assert len(set(pairs.values())) == len(pairs)


def test_trie_matches_all_pairs():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(20)})
    root = kernels.trie_links(np.array(prints, np.uint64), np.ones(len(prints), bool), 4, 2)
    assert dict(enumerate(root)) == brute.components(list(enumerate(prints)))


def test_suffix_dedup(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, rows), block_bytes=3000).collect()}
    assert [got[d] for d, _ in rows] == brute.byte_repeats([t for _, t in rows])
    assert any(g[1] for g in got.values())
    assert suffix_dedup.suffix_dedup(frame(spark, rows).limit(0)).count() == 0


def test_substring_dedup(spark):
    rows = corpus(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(frame(spark, rows), block_bytes=3000).collect()}
    assert got == brute.word_repeats(rows)
    again = substring_dedup.substring_dedup(frame(spark, [(1, rows[9][1]), (1, rows[9][1]), (None, rows[9][1])])).collect()
    assert [r.n_removed for r in again if r.doc_id == 1] == [0, 0]


def test_simhash(spark):
    rows = corpus(4)
    prints = [(d, brute.simhash(t)) for d, t in rows]
    want = brute.components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_digest(frame(spark, rows)).collect()}
    assert got == {d: (f, want[d]) for d, f in prints}
    assert simhash.simhash_digest(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) + rng.choice(["", " z", " q r"]) for _ in range(rng.randint(1, 9)))) for i in range(25)] + [(90, None), (91, ""), (92, " \n\t\n")]
    got = {(r.doc_id, r.line_no) for r in line_dedup.later_lines(frame(spark, rows)).collect()}
    assert got == brute.line_repeats(rows)


def test_decontamination_recall(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(30)]
    rows, want = [(100, None), (101, "")], set()
    for i, t in items:
        w = t.split()
        for _ in range(len(w) // 8):  # an eighth of the words edited
            k, kind = rng.randrange(len(w)), rng.randrange(3)
            w[k : k + (kind != 0)] = [word()] if kind < 2 else []
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 50))] + [x.upper() + "," for x in w] + [word() for _ in range(30)])))
        want.add((i, i))
        rows.append((1000 + i, " ".join(word() for _ in range(80))))
    bench = spark.createDataFrame([*items, (500, None), (501, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame(spark, rows), bench, item_words=200).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert decontaminate.matches(frame(spark, rows), bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_langid(spark):
    """Held-out accuracy, exact marginals over blocks, odd texts."""
    rng = random.Random(7)
    ends = {"aa": ["ung", "sch"], "bb": ["tion", "eau"], "cc": ["ado", "ez"]}
    text = lambda l, n: " ".join("".join(rng.choice("bcdfg") for _ in range(2)) + rng.choice(ends[l]) for _ in range(n))
    rows = [(i, text(l, rng.randint(1, 200)), l) for i, l in enumerate(rng.choice(list(ends)) for _ in range(150))] + [(900, None, "aa"), (901, "12 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if got[r[0]].held_out and r[0] < 900]
    assert held and sum(got[d].lang_pred == l for d, _, l in held) >= 0.9 * len(held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and all(0 <= g.score <= 1 for g in got.values())
    e = np.random.default_rng(1).normal(size=(200, 3))
    whole, _ = langid._forward_backward(e[None], model.moves, model.first)
    blocks = langid.document_marginals(e, np.array([200]), model)
    assert np.allclose(blocks[0], whole[0].sum(axis=0), atol=1e-3)
    assert langid.keep_known(docs, model).where("doc_id >= 900").count() == 0


def test_line_dedup_odd_tables(spark):
    """Empty table, repeated rows, clashing columns, odd white space, a text of many lines."""
    empty = frame(spark, []).withColumnRenamed("block", "_gone")
    assert line_dedup.later_lines(empty).count() == 0 and line_dedup.dedup_lines(empty).columns == empty.columns
    line = "one two three four five"
    rows = [(1, line), (1, line), (2, "one\ttwo\x0bthree  four\rfive"), (3, "\n".join(f"{i} {i + 1} {i * 7}" for i in range(9000))), (4, "five four three two one\nx"), (5, line.upper())]
    got = {(r.doc_id, r.line_no) for r in line_dedup.later_lines(frame(spark, rows)).collect()}
    assert got == brute.line_repeats([r for r in rows if r[0] != 3]) - {(1, 0)} | {(d, i) for d, i in got if d == 3}
    assert {i for d, i in got if d == 3} == set()
