"""The near-dedup stage against brute force."""

import random

import brute

import corpus_pipeline
from lattika.llm import near_dedup


def shingles(text, k=5):
    w = brute.words((text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def groups(rows):
    """Smallest doc_id of those reachable over pairs of Jaccard similarity 0.8 or more, by doc_id."""
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def near_copies(seed, originals=12, copies=7):
    """Texts with near copies at Jaccard 0.7 to 0.97, exact copies, empty and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "a b", "a  B", "a c", "a b c d e f", "a b c d e g"]
    for i in range(originals):
        w = [word() for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(w))
        for c in range(copies):
            x = list(w)
            for _ in range(max(1, len(w) * c // 250)):
                x[rng.randrange(len(x))] = word()
            texts.append(" ".join(x))
        texts.append(" ".join(w).upper())
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(d, texts[i]) for d, i in enumerate(order)]


def test_near_dedup_stage_matches_brute_force(spark):
    rows = near_copies(11)
    want = groups(rows)
    assert 12 < len(set(want.values())) < len(rows) - 12
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(set(want.values()))
    assert stage(spark, docs.limit(0), "").count() == 0


def test_near_dedup_of_a_large_group(spark):
    """More near copies than leaders, similar to the original and not to each other."""
    rng = random.Random(3)
    w = [str(i) for i in range(300)]
    rows = []
    for d in range(40):
        x = list(w)
        for _ in range(6):
            x[rng.randrange(300)] = f"z{rng.random()}"
        rows.append((d, " ".join(x)))
    rows.append((40, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)


def test_run_stage_by_stage(spark, tmp_path):
    """run() on a small table, every stage against a plain form on that stage's own input."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    sf = "/root/testdata/sf0.001"
    base = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    top = max(r[0] for r in base)
    extra = [(top + 1, base[3][1], base[3][2], base[3][3], 1), (top + 1, base[3][1], base[3][2], base[3][3], 1), (None, base[5][1] + " zzz", base[5][2], None, 2), (top + 2, None, "en", "s", 0), (top + 3, "", "en", "s", 0)]
    for k, r in enumerate(x for x in base if x[1] and 100 < len(x[1].split()) < 400):
        w = r[1].split(" ")
        w[rng.randrange(len(w))] = word()
        extra.append((top + 10 + k, " ".join(w), r[2], r[3], len(r[1])))
    docs = spark.createDataFrame([(*r, "x") for r in base + extra], "doc_id long, text string, lang string, source string, n_chars long, _id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    before, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        outs[name] = before = spark.read.parquet(f"{tmp_path}/{name}")
        assert set(docs.columns) <= set(before.columns)
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
    kept = {n: [(r.doc_id, r.text) for r in df.collect()] for n, df in outs.items()}
    # Language ID: rows as they were, without texts that have no letters.
    assert set(kept["language_id"]) <= {(r[0], r[1]) for r in base + extra} and all(t for _, t in kept["language_id"])
    assert len(kept["language_id"]) > 0.8 * len(base)
    # Line dedup: what is left are the lines without an earlier similar one.
    named = sorted({(d if d is not None else -1, t) for d, t in kept["language_id"]})
    once = [(k, t) for k, (_, t) in enumerate(named)]
    gone = brute.line_repeats(once)
    want = {(named[k][0], "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)) for k, t in once}
    assert {(d if d is not None else -1, t) for d, t in kept["line_dedup"]} == {x for x in want if brute.words(x[1])}
    # Near-dedup: one row of each group.
    rows = sorted(set(kept["line_dedup"]), key=lambda r: (r[0] is None, r[0] or 0))
    root = groups([(k, t) for k, (_, t) in enumerate(rows)])
    assert sorted(map(str, kept["near_dedup"])) == sorted(str(rows[k]) for k in set(root.values()))
    # Decontamination: nothing goes that holds no item.
    from test_decontaminate import brute as held

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    short = [(d, t) for d, t in kept["near_dedup"] if len(t) < 1500]
    bad = {d for d, _ in held(short, items[:8])}
    assert bad <= {d for d, _ in kept["near_dedup"]} - {d for d, _ in kept["decontamination"]}
    assert set(kept["decontamination"]) <= set(kept["near_dedup"])
    # Mixing: sources come near their targets, nothing beyond three times a document.
    taken, target = {}, {}
    for r in outs["mixing"].collect():
        assert 0 < r.taken <= 3 * r.size and r.size == len(brute.words(r.text))
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
    assert sorted(x for x in corpus_pipeline.run(spark, str(tmp_path)).columns) == sorted(outs["mixing"].columns)
