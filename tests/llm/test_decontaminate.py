"""Matches against brute force, recall at the full allowance, odd tables."""

import random

from lattika.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id string, _bad int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def edited(rng, w, edits, word):
    w = list(w)
    for _ in range(edits):
        k, kind = rng.randrange(len(w)), rng.randrange(3)
        w[k : k + (kind != 0)] = [word()] if kind < 2 else []
    return w


def brute(docs, items):
    """(doc, item): edits of the best part of each document, where at most a fifth of the item's words."""
    out = {}
    for d, t in docs:
        w = D.flat(t).split()
        for i, x in items:
            own = D.flat(x).split()
            row = [0] * (len(w) + 1)
            for a, p in enumerate(own, 1):
                new = [a]
                for b, q in enumerate(w, 1):
                    new.append(min(row[b - 1] + (p != q), row[b] + 1, new[b - 1] + 1))
                row = new
            if own and min(row) <= (D.edits_allowed(len(own)) if len(own) >= D.LEAST else 0):
                out[d, i] = min(row)
    return out


def test_against_brute_force(spark):
    rng = random.Random(16)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    word = lambda: rng.choice(vocab)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 11, 12, 13, 17, 25, 40, 60])] + [(50, None), (51, "..."), (52, " ")]
    docs = [(900, None), (901, ""), (902, " \n")]
    for k in range(60):
        i, t = rng.choice(items[4:14])
        w = t.split()
        docs.append((k, " ".join([word() for _ in range(rng.randint(0, 9))] + edited(rng, w, rng.randint(0, len(w) // 3), word) + [word() for _ in range(rng.randint(0, 9))])))
    docs += [(3, docs[6][1]), (None, items[12][1])]  # repeated ids
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.edits for r in D.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(k in want for k in got) and sum(got.get(k) == e for k, e in want.items()) >= 0.95 * len(want)
    assert all(k in got for k, e in want.items() if e == 0)


def test_recall_at_the_full_allowance(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 15, 20, 40, 80])))) for i in range(300)]
    docs = [(i, " ".join([word() for _ in range(rng.randint(0, 40))] + edited(rng, t.split(), D.edits_allowed(len(t.split())), word) + [word() for _ in range(20)])) for i, t in items]
    got = {(r.doc_id, r.item_id) for r in D.matches(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(a == b for a, b in got) and len(got) >= 0.93 * len(items)


def test_odd_tables_and_long_texts(spark, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    long = " ".join(["filler"] * 50000 + [f"w{i}" for i in range(30)] + ["filler"] * 50000)
    docs = frame(spark, [(1, long), (2, "clean text"), (2, "clean text"), (3, None)])
    got = D.matches(docs, bench).collect()
    assert [(r.doc_id, r.edits, r.start_word) for r in got] == [(1, 0, 50000)]
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]
    assert D.matches(docs.limit(0), bench).count() == 0 and D.clean(docs.limit(0), bench).count() == 0
